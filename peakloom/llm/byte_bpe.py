"""Byte-level BPE encoding and decoding by ranked merges, folded with Spark's higher-order functions.

Texts are split by the tokenizer's pattern into blocks: each keeps its distinct words once and its texts as word
numbers. The distinct words of all blocks are encoded in the JVM: an array of byte ids is folded, each step merges the
leftmost of the pairs with the lowest rank, which a literal map of ranks gives. What a word encodes to goes back to the
blocks that have it, and each block spells its texts' ids. Occurrences of words are never shuffled, only each block's
distinct ones. Decoding joins the pieces that the ids stand for.
"""

from __future__ import annotations

import base64
import functools
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import text_of
from peakloom.llm.sentencepiece_bpe import NONE, merge, ranges
from peakloom.session import scratch_path

#: Bytes of text in a block; a longer text is one of its own.
BLOCK_BYTES = 32 << 20
#: Longest word, in bytes, that is folded; a step of the fold takes time in proportion to the word, so longer ones
#: (runs of thousands of signs without a space) are merged in numpy, all occurrences of a pair at once.
FOLD_BYTES = 256
#: Ids of a vocabulary are below this; numbers from it on say that two pieces have no merge.
LIMIT = 1 << 20
#: Entries of the literal rank map that share a slot, about.
SLOT_ENTRIES = 2
#: Places are 64-bit numbers: a block's number, then a word's in so many bits.
PLACE_BITS = 27
#: Bytes of text that a task splits at once.
STEP_BYTES = 2 << 20
#: Ids that a task returns at once.
STEP_IDS = 500_000


class Vocabulary:
    """The ranks of a tiktoken file: pieces by id, and the rank of every pair of pieces whose concatenation is one."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"{path} has no piece for the byte {missing[0]}")
        if max(self.ranks.values()) >= LIMIT:
            raise ValueError(f"{path} has ids of {LIMIT} and more")
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs = {(self.ranks[p[:k]], self.ranks[p[k:]]): r for p, r in self.ranks.items() for k in range(1, len(p)) if p[:k] in self.ranks and p[k:] in self.ranks}
        slots = 1
        while slots * SLOT_ENTRIES < len(self.pairs):
            slots *= 2
        #: By slot: key, rank, key, rank... Keys are numbers from LIMIT on and ranks below it; no slot is empty.
        self.slots: list[list[int]] = [[] for _ in range(slots)]
        for (a, b), r in self.pairs.items():
            self.slots[(a * 7919 + b) & (slots - 1)] += [(a + 1) * LIMIT + b, r]
        self.slots = [s or [LIMIT * LIMIT] for s in self.slots]

    def literal(self, values: list, kind: str) -> Column:
        """A constant of many values: Spark folds the parsing away."""
        return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), kind)

    @functools.cached_property
    def sorted_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and ranks of the pairs, by key."""
        table = np.array(sorted((a * LIMIT + b, r) for (a, b), r in self.pairs.items()), np.int64).reshape(-1, 2)
        return table[:, 0].copy(), table[:, 1].copy()

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE: no piece) and the piece it makes, which has the rank as its id."""
        keys, ranks = self.sorted_pairs
        key = left * LIMIT + right
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        return np.where(hit, ranks[at], NONE), ranks[at]


@functools.lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


class Merges:
    """A vocabulary as sentencepiece_bpe.merge takes it."""

    def __init__(self, vocabulary: Vocabulary):
        self.ranks = vocabulary.ranked


def bind(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def folded(word: Column, vocabulary: Vocabulary) -> Column:
    """Ids of a binary word: its bytes, merged pair by pair."""
    byte_ids = vocabulary.literal(vocabulary.byte_ids, "array<bigint>")
    letters = F.split(F.decode(word, "ISO-8859-1"), "")  # a character for each byte
    ids = F.transform(letters, lambda c: F.get(byte_ids, F.ascii(c)))
    # the rank map is one constant of the plan, to which the lambdas refer by name
    return bind(vocabulary.literal(vocabulary.slots, "array<array<bigint>>"), lambda slots: bind(ids, lambda i: fold_merges(i, slots, len(vocabulary.slots) - 1))).cast("array<int>")


def fold_merges(ids: Column, slots: Column, mask: int) -> Column:
    """Ids after all merges; each step takes the leftmost of the pairs with the lowest rank and renews the ranks beside it."""

    def rank(a: Column, b: Column) -> Column:
        """Of a pair without a merge: a key, thus LIMIT or more."""
        slot = F.get(slots, (a * 7919 + b).bitwiseAND(F.lit(mask)).cast("int"))
        return F.get(slot, F.array_position(slot, (a + 1) * LIMIT + b).cast("int"))

    def merged(s: Column, low: Column, p: Column) -> Column:
        """The state after the pair at p (from 1), whose rank and piece are `low`."""
        p = p.cast("int")
        ids, ranks = s["ids"], s["ranks"]
        none = F.array().cast("array<bigint>")
        left = F.when(p > 1, F.array(rank(F.get(ids, p - 2), low))).otherwise(none)
        right = F.when(p + 1 < F.size(ids), F.array(rank(low, F.get(ids, p + 1)))).otherwise(none)
        return F.struct(
            F.concat(F.slice(ids, F.lit(1), p - 1), F.array(low), F.slice(ids, p + 2, F.size(ids))).alias("ids"),
            F.concat(F.slice(ranks, F.lit(1), F.greatest(p - 2, F.lit(0))), left, right, F.slice(ranks, p + 2, F.size(ids))).alias("ranks"),
        )

    def step(s: Column, _: Column) -> Column:
        return bind(F.array_min(s["ranks"]), lambda low: F.when(low < LIMIT, bind(F.array_position(s["ranks"], low), lambda p: merged(s, low, p))).otherwise(s))

    pairs = F.zip_with(F.slice(ids, F.lit(1), F.size(ids) - 1), F.slice(ids, F.lit(2), F.size(ids) - 1), rank)
    return F.aggregate(F.array_repeat(F.lit(0), F.size(ids) - 1), F.struct(ids.alias("ids"), pairs.alias("ranks")), step, lambda s: s["ids"])


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """words (word binary, not empty, and any other columns) with `ids`. A word that is a piece itself has its id; others are merged."""
    vocabulary = load(path)
    spark = words.sparkSession
    known = spark.createDataFrame(pa.table({"word": pa.array(list(vocabulary.ranks), pa.binary()), "__id": pa.array(list(vocabulary.ranks.values()), pa.int32())}))
    found = words.join(F.broadcast(known), "word", "left")  # as large as the vocabulary, whatever the input
    short = F.col("__id").isNotNull() | (F.octet_length("word") <= FOLD_BYTES)
    ids = F.when(F.col("__id").isNotNull(), F.array("__id")).otherwise(folded(F.col("word"), vocabulary))
    names = [c for c in words.columns if c != "word"]
    first = found.filter(short).select("word", *names, ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = None
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                merges = merges or Merges(load(path))
                symbols = np.array(load(path).byte_ids, np.int64)[np.frombuffer(one.column(0)[0].as_py(), np.uint8)]
                ids = merge(merges, symbols, np.zeros(len(symbols), np.int64))[0]
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], names=["word", *names, "ids"])

    kinds = dict(words.dtypes)
    rest = found.filter(~short).select("word", *names).mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("word", *names)) + ", ids array<int>")
    return first.unionByName(rest)


#: The pattern of the byte-level tokenizers that split words, numbers, other signs and white space; it is also split by whole arrays.
COMMON_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, WHITE, OTHER = 1, 2, 3, 0


@functools.lru_cache(maxsize=1)
def kinds_of_characters() -> np.ndarray:
    """LETTER, NUMBER, WHITE or OTHER for each code point."""
    import regex

    table = np.zeros(0x110000, np.uint8)
    for base, stop in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(base, stop)))
        for kind, text in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
            for found in regex.finditer(text, every):
                table[base + found.start() : base + found.end()] = kind
    return table


def common_starts(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which characters begin a match of COMMON_PATTERN, in texts that begin where `first` says; every character is in one.

    A run of letters, numbers or other signs is a match, with a space right before it. Of white space before anything
    else the last character stands alone, or is that space. An apostrophe that begins a match takes s, t, m, d, re, ve
    or ll with it.
    """
    kind = kinds_of_characters()[code]
    n = len(code)
    white = kind == WHITE
    last = np.r_[first[1:], True]  # of its text
    before = np.r_[np.uint8(255), kind[:-1]]
    before[first] = 255
    starts = first | (kind != before)
    starts |= white & ~last & np.r_[~white[1:], True]  # the last white character before another sign
    spaced = np.r_[False, code[:-1] == 0x20] & ~first & ~white
    starts &= ~spaced
    at = np.flatnonzero(starts & (code == 0x27) & ~last)
    if len(at):
        one = code[at + 1]
        there = ~last[at + 1]
        two = code[np.minimum(at + 2, n - 1)]
        double = there & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        single = np.isin(one, [ord(c) for c in "stmd"])
        taken = np.where(single, 1, np.where(double, 2, 0))
        at, taken = at[taken > 0], taken[taken > 0]
        starts[at + 1] = False
        after = at + 1 + taken
        starts[after[after < n]] = True
    return starts


def split_common(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(matches of COMMON_PATTERN in all texts one after another, how many each text has)."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    offsets, data = offsets - offsets[0], (texts.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[offsets[0] : offsets[-1]]
    raw = np.frombuffer(data, np.uint8)
    code = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    place = np.flatnonzero((raw & 0xC0) != 0x80)  # of each character
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    at = place[common_starts(code, first[:-1][place])] if len(code) else place
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.r_[at, len(raw)]), pa.py_buffer(data)])
    return words, np.diff(np.searchsorted(at, offsets))


def splitter(pattern: str):
    """A function like split_common for the pattern."""
    if pattern == COMMON_PATTERN:
        return split_common
    import regex

    found = regex.compile(pattern).findall

    def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        lists = [found(t) for t in texts.to_pylist()]
        return pa.array([w.encode() for ws in lists for w in ws], pa.large_binary()), np.array([len(ws) for ws in lists], np.int64)

    return split


class Numbering(dict):
    """Numbers for words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed plane by plane of their bytes."""
    planes = np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return pa.Codec("zstd", compression_level=4).compress(planes.tobytes(), asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def blocks(docs: DataFrame, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """(block, ids, sizes, numbers, words): texts as numbers of words, `sizes` of them each, and the block's distinct words by number."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split = splitter(pattern)
        first, done = TaskContext.get().partitionId() << 16, 0
        held: list[pa.Array] = []
        index, numbers, sizes, size = Numbering(), [], [], 0

        def block() -> pa.RecordBatch:
            if len(index) >> PLACE_BITS or done >> 16:
                raise ValueError("a block has too many words, or a task too many blocks")
            flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int32)
            often = np.argsort(-np.bincount(flat, minlength=len(index)), kind="stable")  # frequent words get small numbers
            again = np.empty(len(index), np.int32)
            again[often] = np.arange(len(index), dtype=np.int32)
            ids, words = pa.chunked_array(held).combine_chunks(), pa.array(list(index), pa.binary()).take(often)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in (ids, pa.array(np.concatenate(sizes), pa.int32()), words)]
            return pa.RecordBatch.from_arrays([pa.array([first + done], pa.int64()), lists[0], lists[1], pa.array([packed(again[flat])], pa.binary()), lists[2]], names=["block", "ids", "sizes", "numbers", "words"])

        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
            lo = 0
            while lo < batch.num_rows:
                base = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, base + STEP_BYTES, "right")))
                words, counts = split(batch.column(1).slice(lo, hi - lo))
                found = words.dictionary_encode()
                own = np.fromiter(map(index.__getitem__, found.dictionary.to_pylist()), np.int32, len(found.dictionary))
                numbers.append(own[found.indices.to_numpy()])
                sizes.append(counts)
                held.append(batch.column(0).slice(lo, hi - lo))
                size, lo = size + int(ends[hi - 1] - base), hi
                if size >= BLOCK_BYTES:
                    yield block()
                    done += 1
                    held, index, numbers, sizes, size = [], Numbering(), [], [], 0
        if held:
            yield block()

    return rows.mapInArrow(run, f"block long, ids array<{kind}>, sizes array<int>, numbers binary, words array<binary>")


def entries(found: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of words, (places, counts) of their ids, all ids) of binary entries: four bytes of number, then `width` of each id, the highest first."""
    found = found.cast(pa.large_binary())
    offsets = np.frombuffer(found.buffers()[1], np.int64)[found.offset : found.offset + len(found) + 1]
    data = np.frombuffer(found.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(found) else np.zeros(0, np.uint8)
    starts = offsets[:-1] - offsets[0]
    counts = (np.diff(offsets) - 4) // width
    body = np.ones(len(data), bool)
    number = np.zeros(len(starts), np.int64)
    for k in range(4):
        number = number << 8 | data[starts + k]
        body[starts + k] = False
    digits, ids = data[body].reshape(-1, width).astype(np.int32), np.zeros(int(counts.sum()), np.int32)
    for k in range(width):
        ids = ids << 8 | digits[:, k]
    return number, np.stack([np.cumsum(counts) - counts, counts]), ids


def spelled(joined: DataFrame, width: int) -> DataFrame:
    """(id, tokens, token_bytes) of blocks (ids, sizes, numbers, found), where found has each word's number and ids as `entries` reads them, `width` bytes an id.

    token_bytes: the tokens as unsigned 32-bit numbers, the lowest byte first.
    """
    kind = joined.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes, numbers, found = (batch.column(c).slice(k, 1) for c in range(4))
                ids, sizes = ids.flatten(), sizes.flatten().to_numpy()
                numbers = unpacked(numbers[0].as_py(), int(sizes.sum()))
                own, at, flat = entries(found.flatten(), width)
                at = at[:, np.argsort(own)]  # by number: each has one entry
                ends = np.r_[0, np.cumsum(sizes)]
                n = np.r_[0, np.cumsum(at[1][numbers])][ends]
                lo = 0
                while lo < len(ids):
                    hi = max(lo + 1, int(np.searchsorted(n, n[lo] + STEP_IDS, "right")) - 1)
                    own = numbers[ends[lo] : ends[hi]]
                    values, cuts = flat[ranges(at[0][own], at[1][own])].astype("<i4"), n[lo : hi + 1] - n[lo]
                    data = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(4 * cuts), pa.py_buffer(values)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, pa.int32())), data], names=["id", "tokens", "token_bytes"])
                    lo = hi

    return joined.select("ids", "sizes", "numbers", "found").mapInArrow(run, f"id {kind}, tokens array<int>, token_bytes binary")


def bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """rows in a table bucketed by key in the shared folder, so that a join by it doesn't shuffle them. The catalogue forgets it with the session."""
    spark, name = rows.sparkSession, f"token_blocks_{uuid.uuid4().hex}"
    rows.write.format("parquet").option("compression", "zstd").bucketBy(buckets, key).sortBy(key).option("path", scratch_path(spark, "token-blocks")).saveAsTable(name)
    return spark.table(name)


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """(id, ids array<int>) of every whole text by the ranks in a tiktoken file, each match of the pattern on its own, without special tokens.

    with_bytes: also ids_bytes, the ids as unsigned 32-bit numbers, the lowest byte first. What the pattern doesn't match isn't encoded, as in the library. A null or empty text has no ids; a null id passes
    through; rows that repeat an id or a text come back as often; an empty table gives no rows; other columns are
    ignored, whatever their names. Characters that no word of the vocabulary has are spelled by their bytes.
    """
    spark: SparkSession = docs.sparkSession
    table = bucketed(blocks(docs, pattern, id_col, text_col), "block", int(spark.conf.get("spark.sql.shuffle.partitions")))
    numbered = table.select("block", F.posexplode("words").alias("number", "word"))
    # a word comes once, with its places: one for each block at most
    words = numbered.groupBy("word").agg(F.collect_list(F.shiftleft("block", PLACE_BITS) + F.col("number")).alias("places"))
    width = 2 if max(load(path).ranks.values()) < 1 << 16 else 3
    packed_ids = F.unhex(F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i), 2 * width, "0")), ""))
    back = encode_words(words, path).select(packed_ids.alias("packed"), F.explode("places").alias("p"))
    entry = F.concat(F.unhex(F.lpad(F.hex(F.col("p").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))), 8, "0")), F.col("packed"))
    found = back.groupBy(F.shiftright("p", PLACE_BITS).alias("block")).agg(F.collect_list(entry).alias("found"))
    joined = table.select("block", "ids", "sizes", "numbers").join(found.hint("merge"), "block", "left")
    joined = joined.withColumn("found", F.coalesce("found", F.array().cast("array<binary>")))
    out = spelled(joined, width).withColumnsRenamed({"tokens": "ids", "token_bytes": "ids_bytes"})
    return out if with_bytes else out.drop("ids_bytes")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with `bytes`, the pieces of its column ids joined. Null or no ids give no bytes; an id that the vocabulary lacks fails."""
    ranks = load(path).ranks
    pieces = [None] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    table = load(path).literal(pieces, "array<string>")
    unknown = F.raise_error(F.lit("the vocabulary lacks an id"))
    joined = F.array_join(F.transform(F.coalesce("ids", F.array().cast("array<int>")), lambda i: F.coalesce(F.get(table, i), unknown)), "")
    return encoded.withColumn("bytes", F.unhex(joined))
