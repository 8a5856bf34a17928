"""Phrases whose words attract each other, from word-id suffix arrays of shards.

A shard (the texts of one step of a task) is numbered by words; its suffixes, each as long as a phrase can be, are
sorted by prefix doubling, and intervals of the sorted suffixes that share n words are the shard's n-grams with their
counts. Counts are merged by key. A phrase that is frequent has frequent words, pairs and triples of words, so the
first pass merges counts of words and pairs by 64-bit hashes, the second those of triples that these leave, and the
third emits only what all leave: a hash that two phrases share lets more through, never less. What comes out is
counted by its words and exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakloom.llm.common import text_of
from peakloom.llm.sentencepiece_bpe import ranges
from peakloom.session import materialize

#: Most words of a phrase, and times that one must occur.
MOST_WORDS, LEAST = 5, 100
#: Phrases that are listed of each language.
LISTED = 2000
#: Bytes of text in a shard; a longer text is one of its own.
SHARD_BYTES = 3 << 20
#: Rows that a task returns at once, and rows of its shards that it merges before it returns them.
STEP_ROWS, MERGE_ROWS = 1 << 16, 1 << 20
#: Most splits of the input whose phrases one task counts.
GATHERED = 8
#: Bits of the filter of frequent hashes, for each of which it has FILTER_SHARE, within these bounds.
FILTER_SHARE, FILTER_LEAST, FILTER_MOST = 64, 1 << 16, 1 << 27
#: Where the numbers of a hash's bits in the filter begin in it.
FILTER_SHIFTS = (0, 18, 36)
#: Parts into which a language's candidates are dealt before its first ones are taken.
SALTS = 64

NONE_LANG = "und"
SPACE, BREAK = 0x20, 0x0A
# The bytes at which texts are cut into pieces.
CUTS = b".,;:!?\n\x0b\x0c\r"
CODES = np.arange(256, dtype=np.uint8)
CODES[ord("A") : ord("Z") + 1] += 32
CODES[ord("\t")] = SPACE
CODES[list(CUTS)] = BREAK

WEIGHT = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) ^ (x >> np.uint64(32))


def hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of binary values, the same in every shard."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    sizes = np.diff(offsets)
    if not len(sizes) or not sizes.sum():
        return np.zeros(len(sizes), np.uint64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    powers = np.cumprod(np.full(int(sizes.max()), WEIGHT, np.uint64))
    data *= powers[ranges(np.zeros(len(sizes), np.int64), sizes)]
    ends = np.cumsum(data)  # wraps around, and so do differences
    ends = np.r_[np.uint64(0), ends]
    at = offsets - offsets[0]
    return mixed(ends[at[1:]] - ends[at[:-1]])


@dataclass
class Shard:
    """Words of some texts in order: number of each in its language, words left in its piece (itself included), and the tables by number."""

    word: np.ndarray
    left: np.ndarray
    spelling: np.ndarray  # by number: place in `words`
    language: np.ndarray  # by number: place in `langs`
    words: pa.Array
    langs: list[str]

    @classmethod
    def of(cls, langs: pa.Array, texts: pa.Array) -> Shard:
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        code = CODES[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data else np.zeros(0, np.uint8)
        begins = (offsets - offsets[0])[:-1]
        first = np.zeros(len(code) + 1, bool)  # of a text
        first[begins] = True
        inside = (code != SPACE) & (code != BREAK)
        starts = np.flatnonzero(inside & (first[:-1] | ~np.r_[False, inside[:-1]]))
        ends = np.flatnonzero(inside & (first[1:] | ~np.r_[inside[1:], False])) + 1
        packed = np.r_[0, np.cumsum(ends - starts)]
        all_words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(packed), pa.py_buffer(code[inside])])
        found = all_words.dictionary_encode()
        names = langs.fill_null(NONE_LANG).dictionary_encode()
        text = np.searchsorted(begins, starts, "right") - 1
        own = names.indices.to_numpy().astype(np.int64)
        # texts without a byte share their place with the next one: the last of them that begins there has the word
        key = own[text] * max(1, len(found.dictionary)) + found.indices.to_numpy() if len(starts) else np.zeros(0, np.int64)
        kinds, word = np.unique(key, return_inverse=True) if len(names.dictionary) * len(found.dictionary) > 1 << 26 else dense(key, len(names.dictionary) * len(found.dictionary))
        piece = np.searchsorted(np.flatnonzero(code == BREAK), starts)
        last = np.r_[(piece[1:] != piece[:-1]) | (text[1:] != text[:-1]), np.ones(min(1, len(starts)), bool)]
        n = max(1, len(found.dictionary))
        return cls(word.astype(np.int32), until(last).astype(np.int32), kinds % n, kinds // n, found.dictionary, names.dictionary.to_pylist())

    def spelled(self, at: np.ndarray, n: int) -> pa.Array:
        """The phrases of n words that begin at the places, joined by spaces."""
        offsets = np.frombuffer(self.words.buffers()[1], np.int64)[self.words.offset : self.words.offset + len(self.words) + 1]
        sizes = np.diff(offsets)
        data = np.frombuffer(self.words.buffers()[2] or b"", np.uint8)
        spelling = self.spelling[self.word[at[:, None] + np.arange(n)]].ravel()
        own = sizes[spelling] + 1
        out = np.full(int(own.sum()), SPACE, np.uint8)
        ends = np.cumsum(own)
        out[ranges(ends - own, own - 1)] = data[ranges(offsets[spelling], own - 1)]
        inner = np.ones(len(out), bool)
        inner[ends[n - 1 :: n] - 1] = False  # no space after a phrase
        totals = own.reshape(-1, n).sum(axis=1) - 1
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.r_[0, np.cumsum(totals)]), pa.py_buffer(out[inner])]).cast(pa.string())

    def hashed(self, at: np.ndarray, n: int, own: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """Hashes of the phrases of n words that begin at the places; own and langs: those of words and languages."""
        h = langs[self.language[self.word[at]]]
        for k in range(n):
            h = mixed(h * WEIGHT + own[self.spelling[self.word[at + k]]])
        return h


def dense(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with inverse, by a table of all possible keys."""
    there = np.zeros(size, bool)
    there[key] = True
    return np.flatnonzero(there), (np.cumsum(there, dtype=np.int64) - 1)[key]


def until(last: np.ndarray) -> np.ndarray:
    """For each place how many there are up to the next one that is the last of its run, itself included."""
    ends = np.flatnonzero(last)
    return ends[np.searchsorted(ends, np.arange(len(last)))] - np.arange(len(last)) + 1 if len(last) else np.zeros(0, np.int64)


def suffix_order(word: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the words from there, `depth` of them or as many as are left, by prefix doubling."""
    rank, have = word.astype(np.int64) + 1, 1
    order = np.argsort(rank, kind="stable") if depth == 1 else None
    while have < depth:
        after = np.zeros(len(rank), np.int64)
        some = np.flatnonzero(left > have)
        after[some] = rank[some + have]
        key = rank * (int(rank.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]][: len(key)])
        have *= 2
    return order


def common_prefixes(word: np.ndarray, left: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Words, up to depth, that each suffix in the order shares with the one before it."""
    a, b = order[:-1], order[1:]
    out, same = np.zeros(max(0, len(order) - 1), np.int8), np.ones(max(0, len(order) - 1), bool)
    for k in range(depth):
        same &= (left[a] > k) & (left[b] > k)
        at = np.flatnonzero(same)
        same[at] = word[a[at] + k] == word[b[at] + k]
        out += same
    return out


def ngrams(word: np.ndarray, left: np.ndarray, lengths: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, a place of each n-gram, its count): the intervals of the suffix array whose neighbours share n words."""
    depth = lengths[-1]
    order = suffix_order(word, left, depth)
    shared = common_prefixes(word, left, order, depth)
    for n in lengths:
        heads = np.flatnonzero(np.r_[True, shared < n][: len(order)])
        at, counts = order[heads], np.diff(np.r_[heads, len(order)])
        whole = left[at] >= n
        yield n, at[whole], counts[whole]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Batches of (lang, text) in shards."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lo, sizes = 0, np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
        while lo < batch.num_rows:
            base = sizes[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(sizes, base + SHARD_BYTES - size, "right")))
            part = batch.slice(lo, hi - lo)
            held.append(part)
            size, lo = size + int(sizes[hi - 1] - base), hi
            if size >= SHARD_BYTES or hi < batch.num_rows:
                yield joined(held)
                held, size = [], 0
    if held:
        yield joined(held)


def joined(held: list[pa.RecordBatch]) -> Shard:
    table = pa.Table.from_batches(held).combine_chunks()
    return Shard.of(table.column(0).combine_chunks(), table.column(1).combine_chunks())


def rows_of(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE_LANG)).alias("lang"), text_of(text_col).alias("text"))


def passing_pairs(s: Shard, bits: np.ndarray, own: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of each word, whether it passes the filter, places at which pairs begin that pass with both their words)."""
    place = np.zeros(len(s.spelling), np.int64)
    place[s.word] = np.arange(len(s.word))
    fit = passing(bits, s.hashed(place, 1, own, langs)) if len(place) else np.zeros(0, bool)
    pairs = np.flatnonzero((s.left > 1) & fit[s.word])
    pairs = pairs[fit[s.word[pairs + 1]]]
    return place, fit, pairs[passing(bits, s.hashed(pairs, 2, own, langs))]


def run_places(begins: np.ndarray, size: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in phrases of `size` words that begin at the given ones of all, words from each on in such phrases one place after another; 1 where none begins)."""
    goes_on, inside = np.zeros(total, bool), np.zeros(total, bool)
    goes_on[begins] = True
    for k in range(size):
        inside[begins + k] = True
    places = np.flatnonzero(inside)
    begun = goes_on[places]
    return places, np.where(begun, until(~begun) + size - 2, 1).astype(np.int32)


def hash_counts(rows: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """(hash, c): counts by hash, a row for each shard that has them: of words and pairs, or of triples whose pairs pass the filter of those."""
    shared = None if bits is None else rows.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in shards(batches):
            own, langs = hashes(s.words), hashes(pa.array([x.encode() for x in s.langs], pa.large_binary()))
            if shared is None:
                inside, left, lengths = np.arange(len(s.word)), s.left, range(1, 3)
            else:
                inside, left = run_places(passing_pairs(s, shared.value, own, langs)[2], 2, len(s.word))
                lengths = range(3, 4)
            for n, at, counts in ngrams(s.word[inside], left, lengths):
                for lo in range(0, len(at), STEP_ROWS):
                    h = s.hashed(inside[at[lo : lo + STEP_ROWS]], n, own, langs).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(counts[lo : lo + STEP_ROWS], pa.int64())], names=["hash", "c"])

    return rows.mapInArrow(run, "hash long, c long")


def filter_bits(frequent: DataFrame) -> np.ndarray:
    """A Bloom filter of the hashes, three bits for each, as 64-bit words: at most FILTER_MOST bits however many there are (then it lets more through)."""
    bits = FILTER_LEAST
    wanted = FILTER_SHARE * frequent.count()
    while bits < min(wanted, FILTER_MOST):
        bits *= 2
    places = F.array(*[F.shiftrightunsigned("hash", s).bitwiseAND(F.lit(bits - 1)) for s in FILTER_SHIFTS])
    slots = frequent.select(F.explode(places).alias("p")).select(F.shiftright("p", 6).alias("slot"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    out = np.zeros(bits // 64, np.int64)
    got = slots.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()  # bits / 64 rows at most
    out[got["slot"].to_numpy()] = got["bits"].to_numpy()
    return out.view(np.uint64)


def passing(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for shift in FILTER_SHIFTS:
        at = (h >> np.uint64(shift)) & np.uint64(64 * len(bits) - 1)
        ok &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return ok


def combined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, phrase, words, c) of a task's shards with the counts of equal phrases added up, as far as MERGE_ROWS of them go together."""
    held: list[pa.RecordBatch] = []
    n = 0

    def added_up() -> pa.Table:
        table = pa.Table.from_batches(held).group_by(["lang", "phrase", "words"], use_threads=False).aggregate([("c", "sum")])
        return table.rename_columns(["lang", "phrase", "words", "c"])

    for b in parts:
        held.append(b)
        n += b.num_rows
        if n >= MERGE_ROWS:
            table = added_up()
            if table.num_rows > MERGE_ROWS // 2:  # little was equal
                yield from table.to_batches(STEP_ROWS)
                held, n = [], 0
            else:
                held, n = table.to_batches(), table.num_rows
    if held:
        yield from added_up().to_batches(STEP_ROWS)


def gathered(rows: DataFrame) -> DataFrame:
    """The rows in fewer partitions: up to GATHERED together, as long as there are two for each core."""
    n = rows.rdd.getNumPartitions()
    return rows.coalesce(max(1, min(n, max(-(-n // GATHERED), 2 * rows.sparkSession.sparkContext.defaultParallelism))))


def phrase_counts(rows: DataFrame, bits: np.ndarray, most_words: int) -> DataFrame:
    """(lang, phrase, words, c): the words and phrases that the filter leaves, and all words of a language with a null phrase."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)  # FILTER_MOST bits at most

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "phrase", "words", "c"]

        def out(s: Shard, langs: np.ndarray, phrases: pa.Array, n: int, counts: np.ndarray) -> pa.RecordBatch:
            kind = pa.DictionaryArray.from_arrays(pa.array(langs, pa.int32()), pa.array(s.langs, pa.string())).cast(pa.string())
            return pa.RecordBatch.from_arrays([kind, phrases, pa.array(np.full(len(counts), n, np.int32)), pa.array(counts, pa.int64())], names=names)

        for s in shards(batches):
            own, langs = hashes(s.words), hashes(pa.array([x.encode() for x in s.langs], pa.large_binary()))
            counts, (place, fit, pairs) = np.bincount(s.word, minlength=len(s.spelling)), passing_pairs(s, bits := shared.value, own, langs)
            totals = np.bincount(s.language[s.word], minlength=len(s.langs))
            yield out(s, np.arange(len(s.langs)), pa.nulls(len(s.langs), pa.string()), 0, totals)
            if fit.any():
                yield out(s, s.language[fit], s.spelled(place[fit], 1), 1, counts[fit])
            paired = np.zeros(len(s.word) + 1, bool)
            paired[pairs] = True
            triples = pairs[paired[pairs + 1]]
            triples = triples[passing(bits, s.hashed(triples, 3, own, langs))]
            for size, begins, lengths in ((2, pairs, range(2, min(2, most_words) + 1)), (3, triples, range(3, most_words + 1))):
                if not lengths or not len(begins):
                    continue
                inside, left = run_places(begins, size, len(s.word))
                for n, at, c in ngrams(s.word[inside], left, lengths):
                    for lo in range(0, len(at), STEP_ROWS):
                        part = inside[at[lo : lo + STEP_ROWS]]
                        yield out(s, s.language[s.word[part]], s.spelled(part, n), n, c[lo : lo + STEP_ROWS])

    return rows.mapInArrow(lambda batches: combined(counted(batches)), "lang string, phrase string, words int, c long")


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = MOST_WORDS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of all words and phrases that occur at least `least` times, (lang, n): all words of each language)."""
    rows = rows_of(docs, text_col, lang_col)
    # shards have each hash once and tasks few shards, so nothing is gained by adding up before the exchange
    merged = lambda counts: counts.repartition("hash").groupBy("hash").agg(F.sum("c").alias("c")).filter(F.col("c") >= least).select("hash")
    frequent = materialize(merged(hash_counts(rows)), "frequent-hashes")
    bits = filter_bits(frequent)
    if most_words > 2:
        bits = filter_bits(frequent.union(materialize(merged(hash_counts(rows, bits)), "frequent-triples")))
    # a task of more texts adds up more counts of a phrase before the exchange
    counted = phrase_counts(gathered(rows), bits, most_words).groupBy("lang", "phrase").agg(F.max("words").alias("words"), F.sum("c").alias("f"))
    counted = materialize(counted.filter(F.col("phrase").isNull() | (F.col("f") >= least)), "frequent-phrases")
    return counted.filter("phrase is not null"), counted.filter("phrase is null").select("lang", F.col("f").alias("n"))


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of phrases of two words and more: floor(1000 a n / (l r)) of the lowest-scoring cut, the first of equal ones."""
    split = F.split("phrase", " ")
    cuts = frequent.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), split.alias("w"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = cuts.select("lang", "phrase", "words", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    known = frequent.select("lang", "phrase", "f")
    both = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(38,0)) * r)")
    best = both.join(totals, "lang").withColumn("score", score).groupBy("lang", "phrase").agg(F.max("words").alias("words"), F.max("a").alias("a"), F.max("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def outgrown(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, longest): for phrases inside longer frequent ones, the largest count of such a one."""
    w = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.expr("sequence(2, words - 1)"), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))))
    return frequent.filter("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_words: int = MOST_WORDS, least: int = LEAST, listed: int = LISTED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `listed` phrases of each language by score, count and spelling.

    Texts are lower-cased in A-Z, cut into pieces at CUTS and those into words at spaces and tabs. A null text counts as
    empty and a null lang as `und`; a lang may have any spelling. A phrase that lies in a longer frequent one which is
    as frequent is left out. Ties in score and count go by the bytes of the phrase. Rows that repeat a text count each.
    A language without frequent phrases has no rows; an empty table gives none. Other columns are ignored.
    """
    frequent, totals = frequent_phrases(docs, text_col, lang_col, most_words, least)
    found = scored(frequent, totals).join(outgrown(frequent), ["lang", "phrase"], "left").filter(F.col("longest").isNull() | (F.col("longest") < F.col("a")))
    by = [F.desc("score"), F.desc("a"), "phrase"]
    # first among the parts of a language, so that no task sorts all its phrases
    dealt = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    part = dealt.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*by))).filter(F.col("place") <= listed)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).filter(F.col("rank") <= listed)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
