"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

Documents with equal shingle sets are one class. A class's signature has KEY_SLOTS slots of 16 bits in CHUNKS chunks
and further slots of 8 bits. Two signatures that differ in fewer than CHUNKS * (ERRORS + 1) of the key slots agree on
some chunk in all slots but ERRORS, so listing each chunk once for each slot left out finds all such pairs (the
pigeonhole principle). Pairs that meet are held against all slots, and what remains is confirmed on the full sets.

Groups of copies aren't expanded into pairs. In three rounds (a leader for each key; the nearest member of another
component; all members of other components) pairs are confirmed and components merged, so a pair is only looked at
while its ends are still apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import join_groups, text_of
from peakloom.llm.graph import components
from peakloom.session import materialize

CHUNKS, CHUNK_SLOTS, ERRORS = 12, 5, 1
KEY_SLOTS, MORE_SLOTS = CHUNKS * CHUNK_SLOTS, 452
SLOTS = KEY_SLOTS + MORE_SLOTS
#: Pairs whose key slots differ in at most this many are sure to meet.
DISTANCE = CHUNKS * (ERRORS + 1) - 1
#: Chance at most that a pair at just the wanted similarity shares no key; percents for which the layout can't hold it are rejected.
MISS = 1e-6
#: Standard deviations below the wanted similarity at which an estimate from all slots still counts.
MARGIN = 4.5
#: Rows of a key that meet in one call; more are dealt to pairs of blocks.
BLOCK_ROWS = 2048
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


BASE = 0x2545F4914F6CDD1D
INVERSE = pow(BASE, -1, 1 << 64)


def shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's distinct shingles, offsets). Words are runs without ASCII white space, A-Z lower-cased;
    fewer words than width make one shingle."""
    datas = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join(datas) + b" ", np.uint8)
    ends = np.cumsum([len(d) + 1 for d in datas])
    low = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    gap = (low == 32) | ((low >= 9) & (low <= 13))
    edge = np.flatnonzero(np.diff(np.r_[True, gap].astype(np.int8)))
    first, last = edge[::2], edge[1::2]  # words are [first, last)
    # sums of byte * BASE ** place, moved to a common place
    p = powers(len(low), BASE)
    total = np.r_[np.uint64(0), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * p)]
    words = mix((total[last] - total[first]) * powers(len(low), INVERSE)[first])
    text_of_word = np.searchsorted(ends, first, "right")
    n_words = np.bincount(text_of_word, minlength=len(texts))
    start = np.cumsum(n_words) - n_words
    out, sizes = [], []
    grams = np.zeros(0, np.uint64)
    if len(words) >= width:
        grams = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            grams = mix(grams * MULTIPLIER + words[k : len(words) - width + 1 + k])
    for s, n in zip(start.tolist(), n_words.tolist(), strict=True):
        if n >= width:
            own = np.unique(grams[s : s + n - width + 1])
        elif n:
            h = words[s : s + 1].copy()
            for k in range(1, n):
                h = mix(h * MULTIPLIER + words[s + k])
            own = mix(h + np.uint64(n))
        else:
            own = grams[:0]
        out.append(own)
        sizes.append(len(own))
    return np.concatenate(out) if out else grams[:0], np.r_[0, np.cumsum(sizes)].astype(np.int64)


RNG = np.random.default_rng(20240229)
FACTORS = RNG.integers(0, 1 << 31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
OFFSETS = RNG.integers(0, 1 << 32, SLOTS, dtype=np.uint32)


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Slots of 16 bits for each set that isn't empty (zeros for empty ones): (sets, SLOTS)."""
    out = np.zeros((len(offsets) - 1, SLOTS), np.uint16)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(len(offsets) - 1):
        a, b = int(offsets[k]), int(offsets[k + 1])
        if a < b:
            least = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
            for lo in range(a, b, 256):
                np.minimum(least, (x[lo : min(lo + 256, b), None] * FACTORS + OFFSETS).min(axis=0), out=least)
            out[k] = (mix(least.astype(np.uint64)) >> np.uint64(40)).astype(np.uint16)
    return out


def packed(slots: np.ndarray) -> list[bytes]:
    """Key slots with 16 bits, the others with 8."""
    both = np.concatenate([slots[:, :KEY_SLOTS].copy().view(np.uint8), slots[:, KEY_SLOTS:].astype(np.uint8)], axis=1)
    return [r.tobytes() for r in both]


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), 2 * KEY_SLOTS + MORE_SLOTS)
    return flat[:, : 2 * KEY_SLOTS].copy().view(np.uint16), flat[:, 2 * KEY_SLOTS :]


def keys_of(key_slots: np.ndarray) -> np.ndarray:
    """One key for each chunk and slot left out: (signatures, CHUNKS * CHUNK_SLOTS)."""
    s = key_slots.reshape(len(key_slots), CHUNKS, CHUNK_SLOTS).astype(np.uint64)
    out = np.zeros((len(s), CHUNKS, CHUNK_SLOTS), np.uint64)
    for skip in range(CHUNK_SLOTS):
        h = np.zeros(s.shape[:2], np.uint64)
        for k in range(CHUNK_SLOTS):
            if k != skip:
                h = (h << np.uint64(16)) | s[:, :, k]
        out[:, :, skip] = mix(h + MULTIPLIER * (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK_SLOTS) + np.uint64(skip + 1)))
    return out.reshape(len(s), -1).view(np.int64)


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, set_key, sig): set size, 128 bits that stand for the set (null if empty), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                hashes, offsets = shingles(part.column(1).to_pylist(), width)
                n = np.diff(offsets)
                sums = [np.r_[np.uint64(0), np.cumsum(mix(hashes + np.uint64(s)))] for s in (1, 2)]
                halves = np.stack([t[offsets[1:]] - t[offsets[:-1]] for t in sums], axis=1)
                set_key = [h.tobytes() + int(k).to_bytes(4, "little") if k else None for h, k in zip(halves, n, strict=True)]
                sig = packed(signatures(hashes, offsets))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(set_key, pa.binary()), pa.array(sig, pa.binary())], names=["id", "n", "set_key", "sig"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n long, set_key binary, sig binary")


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar enough: 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for lo in range(0, batch.num_rows, 50):
                part = batch.slice(lo, 50)
                n = part.num_rows
                hashes, at = shingles(part.column(2).to_pylist() + part.column(3).to_pylist(), width)
                for k in range(n):
                    a, b = hashes[at[k] : at[k + 1]], hashes[at[n + k] : at[n + k + 1]]
                    both = len(a) + len(b) - len(np.union1d(a, b))
                    keep.append(100 * both >= percent * (len(a) + len(b) - both))
            ok = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def estimate(ka: np.ndarray, ma: np.ndarray, kb: np.ndarray, mb: np.ndarray) -> np.ndarray:
    """Share of agreeing slots."""
    return ((ka == kb).sum(axis=-1) + (ma == mb).sum(axis=-1)) / SLOTS


def least_estimate(percent: int) -> float:
    s = percent / 100
    return s - MARGIN * (s * (1 - s) / SLOTS) ** 0.5


def listed(sigs: DataFrame) -> DataFrame:
    """(id, key) of every key of every signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                k = keys_of(unpacked(part.column(1))[0])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(k)), k.shape[1]))), pa.array(k.ravel())], names=["id", "key"])

    return sigs.select("id", "sig").mapInArrow(run, f"id {sigs.schema['id'].dataType.simpleString()}, key long")


def likely(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """(a, b, likeness) of pairs (a, b) whose signatures are near enough."""
    least = least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                e = estimate(*unpacked(batch.column(2)), *unpacked(batch.column(3)))
                ok = pa.array(e >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok), pa.array(e).filter(ok)], names=["a", "b", "likeness"])

    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}, likeness double")


def apart(members: DataFrame, sigs: DataFrame, comp: DataFrame, percent: int, best: bool) -> DataFrame:
    """(a, b, likeness) of likely pairs of members of one key in different components; each pair from one key only.

    best: of each a only its likeliest b. Otherwise all. Keys whose members are all in one component are left out,
    and keys with more than BLOCK_ROWS members are dealt to pairs of blocks.
    """
    labels = sigs.select("id", "sig").join(comp, sigs["id"] == comp["node"], "left").select("id", "sig", F.coalesce("component", "id").alias("comp"))
    labelled = members.join(labels.select("id", "comp"), "id")
    open_keys = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("rows")).filter("lo != hi")
    open_keys = materialize(open_keys.select("key", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("blocks")), "open-keys")
    rows = members.join(open_keys, "key").join(labels, "id")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.withColumn("block", block).select("key", "id", "comp", "sig", "block", other)
    rows = rows.select("key", "id", "comp", "sig", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    least, kind = least_estimate(percent), sigs.schema["id"].dataType.simpleString()

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        own = t["id"].to_numpy()
        comp_, block_ = t["comp"].to_numpy(), t["block"].to_numpy()
        ks, ms = unpacked(t["sig"].combine_chunks())
        one, two, this = key[1].as_py(), key[2].as_py(), key[0].as_py()
        keys = keys_of(ks)
        out_a, out_b, out_e = [], [], []
        for i in range(len(own)):
            far = comp_ != comp_[i]
            far &= (own != own[i]) if best else (own > own[i])
            if one != two:
                far &= block_ != block_[i]
            j = np.flatnonzero(far)
            if not len(j):
                continue
            e = estimate(ks[i], ms[i], ks[j], ms[j])
            j, e = j[e >= least], e[e >= least]
            if len(j) and best:
                top = int(e.argmax())
                j, e = j[top : top + 1], e[top : top + 1]
            if len(j):  # from the first key that both have; the likeliest of all is the likeliest there too
                first = keys[i][(keys[j] == keys[i]).argmax(axis=1)]
                j, e = j[first == this], e[first == this]
            out_a += [own[i]] * len(j)
            out_b.append(own[j])
            out_e.append(e)
        b = np.concatenate(out_b) if out_b else own[:0]
        return pa.table([pa.array(np.array(out_a, own.dtype)), pa.array(b), pa.array(np.concatenate(out_e) if out_e else np.zeros(0))], names=["a", "b", "likeness"])

    return rows.groupBy("key", "one", "two").applyInArrow(meet, f"a {kind}, b {kind}, likeness double")


def miss_chance(percent: int) -> float:
    """The chance that in every chunk more than ERRORS slots of a pair at the similarity differ."""
    s = percent / 100
    near = sum(math.comb(CHUNK_SLOTS, k) * (1 - s) ** k * s ** (CHUNK_SLOTS - k) for k in range(ERRORS + 1))
    return (1 - near) ** CHUNKS


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every document; linked documents share the smallest id of their component.

    Two documents are linked when 100 * intersection >= percent * union of their shingle sets (shingles of `width`
    words; fewer words are one shingle). Null texts count as empty; documents without words are linked with nothing.
    Rows without an id come back with a null component and aren't linked. Rows that repeat an id and text come back
    once; an empty table gives no rows; other columns are ignored. Integer ids are needed. A percent at which a linked
    pair would be missed with a chance over MISS is rejected.
    """
    if miss_chance(percent) > MISS:
        raise ValueError(f"at {percent}% a pair is missed with a chance of {miss_chance(percent):.2g}, over {MISS:g}: other CHUNKS, CHUNK_SLOTS and ERRORS are needed")
    docs = docs.select(id_col, text_col)
    if repeats(docs, id_col):
        docs = docs.dropDuplicates()
    rows = materialize(sketches(docs, width, id_col, text_col), "sketches")
    full = rows.filter(F.col("set_key").isNotNull() & F.col("id").isNotNull())
    groups = materialize(full.groupBy("set_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "set-classes")
    sigs = materialize(full.join(groups.select(F.col("rep").alias("id"), "set_key"), ["id", "set_key"], "left_semi").select("id", "sig").dropDuplicates(["id"]), "signatures")
    links = find_links(docs, sigs, id_col, text_col, width, percent)
    comp = components(links)
    whole = groups.join(comp, groups["rep"] == comp["node"], "left").select("set_key", "copies", F.coalesce("component", "rep").alias("component"))
    found = join_groups(full.select("id", "n", "set_key"), whole, "set_key", "copies").select("id", "n", "component")
    alone = rows.filter(F.col("set_key").isNull() | F.col("id").isNull()).select("id", "n", F.col("id").alias("component"))
    found = found.unionByName(alone)
    return found.select("id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether an id occurs twice."""
    return not docs.groupBy(id_col).count().filter("count > 1").isEmpty()


def find_links(docs: DataFrame, sigs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(a, b): confirmed links that connect all classes which any links connect."""
    keys = materialize(listed(sigs), "keys")
    leaders = keys.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    members = materialize(keys.join(leaders.select("key", "leader"), "key"), "members")
    star = members.filter(F.col("id") != F.col("leader")).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    met = members.select("id").distinct()
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    texts = materialize(texts.join(met, "id", "left_semi"), "met-texts")
    members = members.select("key", "id")

    near = likely(star, sigs, percent).groupBy("b").agg(F.max_by("a", F.struct("likeness", "a")).alias("a"))
    links = materialize(confirm(near, texts, width, percent), "links")
    for best in (True, False):
        pairs = apart(members, sigs, components(links), percent, best)
        if best:
            pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("likeness", "b")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = materialize(links.union(confirm(pairs, texts, width, percent)), "links")
    return links


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: the one with the smallest id. All columns stay, whatever their names."""
    found = near_duplicates(docs, id_col, text_col, width, percent)
    return docs.join(found.filter(~F.col("kept")).select(F.col("id").alias("__lost")), docs[id_col] == F.col("__lost"), "left_anti")
