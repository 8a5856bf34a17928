"""Removal of repeated substrings by merging Burrows-Wheeler transforms of shards.

Every window of WINDOW bytes has a minimizer, the leftmost smallest hash of GRAM bytes in it. Equal windows have equal
minimizers at equal offsets, so windows are dealt out by minimizer, and consecutive windows with the same one form a
piece. Pieces whose minimizer occurs once are done. The other pieces meet by minimizer: aligned at it they are read as
words of eight bytes, and shards of pieces get a suffix order and a transform each. The transforms are merged by
refining their interleave, one more word a round (rows are stably sorted by the word before them); a boundary
between rows that appears in round d is a common prefix of d - 1 words. Rows that no boundary separates after
WINDOW / 8 - 1 rounds are repeated intervals, and the last eight bytes of each window are compared exactly.

Pieces of a minimizer that is in very many of them are cut into narrower ones and dealt out again, by the bytes that
all windows of such a piece share; those meet and merge in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import release, text_of
from peakloom.llm.minhash import BASE, INVERSE, mix, powers, repeats
from peakloom.session import materialize

WINDOW, GRAM, WORD = 400, 24, 8
#: Window starts that are looked at together; longer texts are cut into overlapping spans.
SPAN = 1 << 20
#: Words in a shard, and words that one merge takes unless a single minimizer has more.
SHARD_WORDS, MERGE_WORDS = 8192, 60_000
#: Pieces of a key that has more distinct ones are cut into windows of fewer offsets and dealt out again by what those share.
HOT_PIECES = 20_000
#: Offsets of the minimizer in the windows of a piece, at each dealing after the first. With one, equal keys are equal windows.
OFFSETS = (48, 8, 1)
POSITION_BITS = 24


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, from running minima of blocks in both directions."""
    n = len(x) - width + 1
    pad = np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)
    blocks = np.r_[x, pad].reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


#: Powers for a span, computed once in a task.
POWERS: list[np.ndarray] = []


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, its place, first start, last start) of each run of windows of the text with one minimizer."""
    if not POWERS:
        POWERS.extend([powers(SPAN + WINDOW, BASE), powers(SPAN + WINDOW, INVERSE)])
    up, down = POWERS
    parts = []
    for lo in range(0, len(data) - WINDOW + 1, SPAN):
        b = np.frombuffer(data, np.uint8, min(SPAN + WINDOW - 1, len(data) - lo), lo)
        total = np.r_[np.uint64(0), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)])]
        grams = mix((total[GRAM:] - total[:-GRAM]) * down[: len(b) - GRAM + 1])
        mark = np.uint64((1 << POSITION_BITS) - 1)
        low = sliding_min((grams & ~mark) | np.arange(len(grams), dtype=np.uint64), WINDOW - GRAM + 1)
        place = (low & mark).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:] - 1, len(place) - 1]
        parts.append((grams[place[first]].view(np.int64), place[first] + lo, first + lo, last + lo))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, np.int64) for _ in range(4))


def shard_transform(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, word before each suffix) of a shard: pieces' words, each piece closed by a 0 at `ends`.

    Suffixes are ordered up to the closing 0, then by place; the word before a piece's first is 0.
    """
    n = len(words)
    rank = words.astype(np.int64)
    # doubling: ranks of 2 ** k words; a closing 0 differs from all others by its place
    rank = np.where(words == 0, np.arange(n), rank + n)
    rank = np.unique(rank, return_inverse=True)[1]
    until = np.repeat(ends, np.diff(np.r_[-1, ends])) - np.arange(n)  # words before the closing 0
    step = 1
    while step < WINDOW // WORD:
        later = np.minimum(np.arange(n) + step, n - 1)
        key = rank * (n + 1) + np.where(step <= until, rank[later] + 1, 0)
        rank = np.unique(key, return_inverse=True)[1]
        step *= 2
    order = np.argsort(rank, kind="stable")
    before = np.where(order > 0, words[order - 1], 0)
    return order, before


def merge_transforms(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge shards' transforms: (shard of each merged row, row within it, common prefix with the row above in words).

    The interleave starts as one shard after the other. In each round the rows, read in the present interleave, are
    stably sorted by the word before them: that is the interleave right for one more word. Common prefixes of
    `rounds` words or more read `rounds`.
    """
    before = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(transforms)), [len(t) for t in transforms])
    base = np.cumsum([0] + [len(t) for t in transforms[:-1]])
    words = before.astype(np.uint16 if before.max(initial=0) < 1 << 16 else np.uint32)
    # a row sorted by its word is, in its shard, the next row with that word: the shard's own stable order
    follows = np.empty(len(before), np.int64)
    for s, t in enumerate(transforms):
        follows[base[s] + np.argsort(t, kind="stable")] = base[s] + np.arange(len(t))
    rows = np.arange(len(before))  # global row numbers in interleave order
    common = np.full(len(before), rounds, np.int64)
    block = np.zeros(len(before), np.int64)
    apart = np.zeros(len(before), bool)
    for d in range(1, rounds + 1):
        read = words[rows]
        turn = np.argsort(read, kind="stable")
        word, from_block = read[turn], block[turn]
        rows = follows[rows[turn]]
        now = np.ones(len(rows), bool)
        now[1:] = (word[1:] != word[:-1]) | (from_block[1:] != from_block[:-1]) | (word[1:] == 0)
        common = np.where(now & ~apart, d - 1, common)
        apart = now
        block = np.cumsum(now)
        if now.all():
            break
    return shard[rows], rows - base[shard[rows]], common


def repeated_windows(pieces: list[bytes], places: list[int]) -> list[np.ndarray]:
    """For each piece a flag for each of its windows: whether the window equals one of another piece.

    places are the minimizer's places in the pieces, at which they are aligned.
    """
    lead = [m % WORD for m in places]  # bytes before the first whole word
    count = np.array([(len(p) - a) // WORD for p, a in zip(pieces, lead, strict=True)])
    flat = np.frombuffer(b"".join(p[a : a + n * WORD] for p, a, n in zip(pieces, lead, count.tolist(), strict=True)), np.uint64)
    symbol = np.unique(flat, return_inverse=True)[1] + 1
    ends = np.cumsum(count + 1) - 1
    words = np.zeros(len(flat) + len(pieces), np.int64)
    inside = np.ones(len(words), bool)
    inside[ends] = False
    words[inside] = symbol
    # shards of whole pieces
    cut = [0]
    for k in range(len(pieces)):
        if ends[k] + 1 - cut[-1] >= SHARD_WORDS or k == len(pieces) - 1:
            cut.append(int(ends[k]) + 1)
    orders, transforms = [], []
    for a, b in zip(cut, cut[1:], strict=False):
        order, before = shard_transform(words[a:b], ends[(ends >= a) & (ends < b)] - a)
        orders.append(order + a)
        transforms.append(before)
    depth = WINDOW // WORD - 1
    shard, row, common = merge_transforms(transforms, depth)
    start = np.concatenate(orders)[np.cumsum([0] + [len(o) for o in orders[:-1]])[shard] + row]  # word place of each row
    same = np.cumsum(np.r_[True, common[1:] < depth])
    size = np.bincount(same)
    keep = (size[same] > 1) & inside[start]
    start, same = start[keep], same[keep]
    piece = np.searchsorted(ends, start)
    first = np.r_[0, ends[:-1] + 1]
    room = ends[piece] - start >= depth
    start, same, piece = start[room], same[room], piece[room]
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    base = np.cumsum(sizes) - sizes
    flag_at = np.r_[0, np.cumsum(sizes - WINDOW + 1)]
    found = np.zeros(flag_at[-1], bool)
    at = np.array(lead)[piece] + (start - first[piece]) * WORD  # byte place in the piece
    for r in range(WORD):  # windows that begin r bytes before a word: r bytes, depth words, WORD - r bytes
        begin = at - r
        ok = (begin >= 0) & (begin + WINDOW <= sizes[piece])
        p, s, b = piece[ok], same[ok], begin[ok]
        if not len(p):
            continue
        g = (base[p] + b)[:, None]
        edge = data[np.concatenate([g + np.arange(r), g + np.arange(r + depth * WORD, WINDOW)], axis=1)]
        edge = np.ascontiguousarray(edge).view(np.uint64).ravel()
        turn = np.lexsort((edge, s))
        eq = (s[turn][1:] == s[turn][:-1]) & (edge[turn][1:] == edge[turn][:-1])
        hit = turn[np.r_[eq, False] | np.r_[False, eq]]
        found[flag_at[p[hit]] + b[hit]] = True
    return np.split(found, flag_at[1:-1])


def spans_of(flags: np.ndarray) -> list[int]:
    """start, length, start, length, ... of the runs of True."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return np.stack([edge[::2], edge[1::2] - edge[::2]], axis=1).ravel().tolist()


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, text): h tells rows without an id apart."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.withColumn("h", F.xxhash64("text"))


def minimizer_runs(rows: DataFrame) -> DataFrame:
    """(id, h, key, place, lo, hi) of all runs of all texts."""
    names = ["id", "h", "key", "place", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n = [], []
            for t in batch.column(2):
                out.append(runs(t.as_py().encode("utf-8", "replace")))
                n.append(len(out[-1][0]))
            if out:
                at = pa.array(np.repeat(np.arange(len(n)), n))
                key, place, lo, hi = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(key), pa.array(place), pa.array(lo), pa.array(hi)], names=names)

    kind = rows.schema["id"].dataType.simpleString()
    long = rows.filter(F.octet_length("text") >= WINDOW).select("id", "h", "text")
    return long.mapInArrow(run, f"id {kind}, h long, key long, place long, lo long, hi long")


def cut_pieces(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, h, key, piece_id, piece, place, starts): the distinct pieces of each text, each with its first window starts."""
    names = ["id", "h", "key", "piece_id", "piece", "place", "starts"]
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for i, h, text, own in zip(*(batch.column(k) for k in range(4)), strict=True):
                data, found = text.as_py().encode("utf-8", "replace"), {}
                for r in own.as_py():
                    piece = data[r["lo"] : r["hi"] + WINDOW]
                    found.setdefault((r["key"], piece, r["place"] - r["lo"]), []).append(r["lo"])
                for (key, piece, place), starts in found.items():
                    digest = blake2b(piece, digest_size=16, salt=place.to_bytes(2, "little")).digest()
                    for c, v in zip(cols, (i.as_py(), h.as_py(), key, digest, piece, place, starts), strict=True):
                        c.append(v)
                if len(cols[0]) > 2000:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, cols, strict=True)), schema)
                    cols = [[] for _ in names]
            yield pa.RecordBatch.from_pydict(dict(zip(names, cols, strict=True)), schema)

    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("id", to_arrow_type(rows.schema["id"].dataType)), ("h", pa.int64()), ("key", pa.int64()), ("piece_id", pa.binary()), ("piece", pa.binary()), ("place", pa.int32()), ("starts", pa.list_(pa.int64()))])
    own = wanted.groupBy("id", "h").agg(F.collect_list(F.struct("key", "place", "lo", "hi")).alias("own")).withColumnsRenamed({"id": "__id", "h": "__h"})
    both = rows.join(own, rows["id"].eqNullSafe(own["__id"]) & (rows["h"] == own["__h"])).select("id", "h", "text", "own")
    return both.mapInArrow(run, f"id {kind}, h long, key long, piece_id binary, piece binary, place int, starts array<long>")


def mark_pieces(pieces: DataFrame, level: int = 0) -> DataFrame:
    """(piece_id, marked): runs of repeated window starts in each of distinct pieces (key, piece_id, piece, place, n).

    Keys of up to HOT_PIECES pieces meet in one task, several at once; the pieces of others are narrowed first.
    """
    hot_keys = materialize(pieces.groupBy("key").agg(F.count(F.lit(1)).alias("pieces")).filter(f"pieces > {HOT_PIECES}").select("key"), "hot-keys")
    all_of_it = pieces.filter("n > 1").select("piece_id", F.array(F.lit(0), F.octet_length("piece") - (WINDOW - 1)).alias("marked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple] = []
        own: list[tuple] = []  # the pieces of one key; they stay together, and a single one has nothing to meet
        words, at = 0, None
        for batch in batches:
            for key, digest, piece, place in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if key != at:
                    if len(own) > 1:
                        pending += own
                        words += sum(len(p) // WORD for _, p, _ in own)
                    own, at = [], key
                    if words >= MERGE_WORDS:
                        yield flush(pending)
                        pending, words = [], 0
                own.append((digest, piece, place))
        if len(own) > 1:
            pending += own
        if pending:
            yield flush(pending)

    def flush(pending: list[tuple]) -> pa.RecordBatch:
        flags = repeated_windows([p for _, p, _ in pending], [m for _, _, m in pending])
        hit = [(d, spans_of(f)) for (d, _, _), f in zip(pending, flags, strict=True) if f.any()]
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in hit], pa.binary()), pa.array([s for _, s in hit], pa.list_(pa.int32()))], names=["piece_id", "marked"])

    cold, some_hot = pieces.select("key", "piece_id", "piece", "place"), level < len(OFFSETS) and not hot_keys.isEmpty()
    if some_hot:
        cold = cold.join(hot_keys, "key", "left_anti")
    dealt = cold.repartition("key").sortWithinPartitions("key")
    found = all_of_it.union(dealt.mapInArrow(run, "piece_id binary, marked array<int>"))
    return found.union(mark_narrowed(pieces.join(hot_keys, "key", "left_semi"), level)) if some_hot else found


def mark_narrowed(pieces: DataFrame, level: int) -> DataFrame:
    """The same for pieces of hot keys: they are cut by the minimizer's offset, and what is marked in a part is marked in the whole."""
    parts = materialize(narrowed(pieces, OFFSETS[level]), "narrow-pieces")
    distinct = parts.groupBy("key", "piece_id").agg(F.first("piece").alias("piece"), F.first("place").alias("place"), F.count(F.lit(1)).alias("n"))
    marked = materialize(mark_pieces(materialize(distinct, "distinct-narrow-pieces"), level + 1), "marked-narrow-pieces")
    both = parts.select("piece_id", "whole_id", "start").join(marked, "piece_id")
    moved = F.transform("marked", lambda x, k: F.when(k % 2 == 0, x + F.col("start")).otherwise(x))
    return both.select(F.col("whole_id").alias("piece_id"), moved.alias("marked"))


def narrowed(pieces: DataFrame, offsets: int) -> DataFrame:
    """(whole_id, start, key, piece_id, piece, place): the parts of each piece whose windows have the minimizer at one of `offsets` neighbouring offsets.

    The key is a hash of the bytes that all windows with these offsets have, so equal windows have equal keys.
    """
    names = ["whole_id", "start", "key", "piece_id", "piece", "place"]
    schema = pa.schema([("whole_id", pa.binary()), ("start", pa.int32()), ("key", pa.int64()), ("piece_id", pa.binary()), ("piece", pa.binary()), ("place", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, whole, piece, place in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                last = len(piece) - WINDOW
                for low in range((place - last) // offsets * offsets, place + 1, offsets):
                    first, end = max(place - low - offsets + 1, 0), min(place - low, last)
                    shared = piece[place - low : place - low - offsets + 1 + WINDOW]
                    part = piece[first : end + WINDOW]
                    own = blake2b(shared, digest_size=8, key=(key % (1 << 64)).to_bytes(8, "little"), salt=low.to_bytes(2, "little")).digest()
                    digest = blake2b(part, digest_size=16, salt=(place - first).to_bytes(2, "little") + low.to_bytes(2, "little")).digest()
                    rows.append((whole, first, int.from_bytes(own, "little", signed=True), digest, part, place - first))
                if len(rows) > 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], names=names)

    return pieces.select("key", "piece_id", "piece", "place").mapInArrow(run, "whole_id binary, start int, key long, piece_id binary, piece binary, place int")


def removed_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, cover): window starts to remove in each text that has any, as arrays of [first start, starts]."""
    rows = keyed(docs, id_col, text_col)
    found = materialize(minimizer_runs(rows), "minimizer-runs")
    often = materialize(found.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("key"), "repeated-minimizers")
    wanted = found.join(often, "key", "left_semi")  # of two tables, so that Spark may split a hot minimizer
    cut = materialize(cut_pieces(rows, wanted), "pieces")
    release(found, often)
    distinct = materialize(cut.groupBy("key", "piece_id").agg(F.first("piece").alias("piece"), F.first("place").alias("place"), F.sum(F.size("starts")).alias("n")), "distinct-pieces")
    marked = materialize(mark_pieces(distinct), "marked-pieces")
    release(distinct)
    hits = cut.select("id", "h", "piece_id", "starts").join(marked, "piece_id")
    return hits.groupBy("id", "h").agg(F.collect_list(F.struct("starts", "marked")).alias("cover"))


def cut_text(data: bytes, cover: list | None) -> tuple[bytes, list[tuple[int, int]]]:
    """(remaining bytes, removed spans)."""
    if not cover:
        return data, []
    delta = np.zeros(len(data) + 1, np.int64)
    for c in cover:
        starts, marked = np.array(c["starts"]), np.array(c["marked"]).reshape(-1, 2)
        lo = (starts[:, None] + marked[None, :, 0]).ravel()
        hi = (starts[:, None] + (marked[:, 0] + marked[:, 1])[None] + (WINDOW - 1)).ravel()
        np.add.at(delta, lo, 1)
        np.add.at(delta, hi, -1)
    gone = np.cumsum(delta[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_bytes: bool = True) -> DataFrame:
    """(id, n_bytes, spans array<struct<start, end>>, kept binary, kept_sha256) of every document.

    Each byte that a string of WINDOW bytes covers which also starts anywhere else is removed; strings are judged on
    the input. Null texts count as empty; texts under WINDOW bytes stay whole; rows with equal texts are copies of
    each other, so from WINDOW bytes on nothing is left of them. Rows that repeat both id and text are one document
    and come back once. An empty table gives no rows; other columns are ignored. kept_bytes=False leaves kept null.
    """
    docs = docs.select(id_col, text_col)
    if repeats(docs, id_col):
        docs = docs.dropDuplicates()
    cover = removed_spans(docs, id_col, text_col).withColumnsRenamed({"id": "__id", "h": "__h"})
    rows = keyed(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, spans, kept, digest = [], [], [], []
            for text, c in zip(batch.column(1), batch.column(2), strict=True):
                data = text.as_py().encode("utf-8", "replace")
                rest, gone = cut_text(data, c.as_py())
                n.append(len(data))
                spans.append([{"start": a, "end": b} for a, b in gone])
                kept.append(rest if kept_bytes else None)
                digest.append(sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array(digest, pa.string())], names=["id", "n_bytes", "spans", "kept", "kept_sha256"])

    both = rows.join(cover, rows["id"].eqNullSafe(cover["__id"]) & (rows["h"] == cover["__h"]), "left").select("id", "text", "cover")
    return both.mapInArrow(run, f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string")
