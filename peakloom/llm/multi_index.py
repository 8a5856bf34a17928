"""Approximate nearest neighbours by multi-index hashing of learned binary codes.

Vectors are normalised, centred and rotated (several rotations by iterative quantisation, fitted on a bounded sample),
and the signs are the code. Codes are cut into chunks of 16 bits, each of which is an index of its own. By the
pigeonhole principle, of two codes within Hamming distance r some chunk c is within t[c], where the t + 1 of all chunks
add up to r + 1; so probing those chunk values finds every code within r. Only codes are shuffled for that; the
vectors of what is found come last and are ranked by their cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakloom.llm.common import join_groups
from peakloom.session import materialize

#: Vectors that the rotations are fitted on.
FIT_ROWS = 10_000
#: Least number of bits in a code: a vector's dimensions times so many rotations as are needed.
BITS, CHUNK = 256, 16
#: Queries whose neighbours are found exactly, among all rows, to fit the radius; share of those neighbours within it.
PILOTS, FIT_RECALL = 64, 0.96
ROUNDS = 30
#: Index rows that a query meets in one block of a bucket, and queries that are compared at once.
ROWS, STEP = 8192, 64
#: Fewest bits of a chunk by which it is bucketed; more when there are more rows.
PREFIX_BITS = 4


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the vectors that take part: an id, no null or non-finite component, not zero."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    ok = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.coalesce(ok, F.lit(False))).select(F.col(id_col).alias("id"), v.alias("vec"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), dims)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that tiny and huge vectors keep their direction
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def fit(rows: DataFrame, seed: int = 5) -> dict | None:
    """Mean and rotations, from FIT_ROWS vectors of the most frequent length drawn by a hash of their ids."""
    top = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not top:
        return None
    dims = top[0]["n"]
    sample = rows.filter(F.size("vec") == dims).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(FIT_ROWS).select("vec").collect()
    x = unit(np.array([r["vec"] for r in sample], np.float64))
    mean, rng = x.mean(axis=0), np.random.default_rng(seed)
    centred, rotations = x - mean, []
    for _ in range(-(-BITS // dims)):
        rotation = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.sign(centred @ rotation).T @ centred)
            rotation = (u @ vt).T
        rotations.append(rotation)
    return {"dims": dims, "mean": mean, "rotation": np.concatenate(rotations, axis=1), "chunks": -(-dims * len(rotations) // CHUNK)}


def encode(unit_vectors: np.ndarray, model: dict) -> np.ndarray:
    """Codes as bytes, padded with zero bits to whole chunks."""
    bits = (unit_vectors - model["mean"]) @ model["rotation"] > 0
    return np.packbits(np.pad(bits, ((0, 0), (0, model["chunks"] * CHUNK - bits.shape[1]))), axis=1)


def encoded(rows: DataFrame, model: dict) -> DataFrame:
    """rows (id, vec and any others) with `code`; vectors of another length than the model's are left out."""
    names = [*rows.columns, "code"]
    at = rows.columns.index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = encode(unit(matrix(b.column(at), model["dims"])), model)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c.tobytes() for c in codes], pa.binary())], names=names)

    fitting = rows.filter(F.size("vec") == model["dims"])
    return fitting.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in [*rows.dtypes, ("code", "binary")]))


def words(codes: list[bytes], chunks: int) -> np.ndarray:
    """Codes as one unsigned number a chunk, the first bit the highest."""
    return np.frombuffer(b"".join(codes), ">u2").reshape(len(codes), chunks).astype(np.uint16)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of paired rows of words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def fit_radius(queries: DataFrame, index: DataFrame, model: dict, k: int, seed: int = 5) -> int:
    """The radius that holds FIT_RECALL of the k nearest of PILOTS queries among all rows: one pass over the index with a few queries."""
    pilots = queries.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(PILOTS).select("id", "vec", "code").collect()
    bits = model["chunks"] * CHUNK
    if not pilots:
        return bits
    q = unit(np.array([p["vec"] for p in pilots], np.float64))
    codes, names = words([bytes(p["code"]) for p in pilots], model["chunks"]), ["pilot", "score", "apart"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, far = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            score = q @ unit(matrix(b.column(0), model["dims"])).T
            score[score > 1 - 1e-12] = -np.inf  # the query itself; copies are in the index once and within any radius
            near = np.argsort(-score, axis=1, kind="stable")[:, :k]
            apart = distances(words(b.column(1).to_pylist(), model["chunks"])[near], codes[:, None])
            all_score = np.concatenate([best, np.take_along_axis(score, near, 1)], axis=1)
            turn = np.argsort(-all_score, axis=1, kind="stable")[:, :k]
            best, far = np.take_along_axis(all_score, turn, 1), np.take_along_axis(np.concatenate([far, apart], axis=1), turn, 1)
        ok = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(ok)[0].astype(np.int32)), pa.array(best[ok]), pa.array(far[ok])], names=names)

    found = index.select("vec", "code").mapInArrow(run, "pilot int, score double, apart long")
    first = Window.partitionBy("pilot").orderBy(F.desc("score"), "apart")
    apart = [r["apart"] for r in found.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k).select("apart").collect()]
    return int(np.quantile(apart, FIT_RECALL, method="higher")) if apart else bits


def thresholds(radius: int, chunks: int) -> list[int]:
    """Largest distance in each chunk: codes within the radius are within at least one of them. -1: not looked at."""
    return [(radius + 1) // chunks + (c < (radius + 1) % chunks) - 1 for c in range(chunks)]


def search(queries: DataFrame, index: DataFrame, model: dict, radius: int) -> DataFrame:
    """(query_id, id, apart): every index row whose code is within the radius of the query's, each pair once.

    A bucket is a chunk and the first bits of its value; large ones are cut into blocks of index rows. The queries that
    probe a block stream past it, so neither side of a bucket is held whole and no row of the index is copied for queries.
    """
    chunks, most = model["chunks"], thresholds(radius, model["chunks"])
    n = index.count()
    prefix_bits = min(CHUNK, max(PREFIX_BITS, (n // ROWS).bit_length() - 1))
    looked_at = [c for c in range(chunks) if most[c] >= 0]
    chunk = F.explode(F.array(*map(F.lit, looked_at))).alias("chunk")
    value = F.conv(F.hex(F.substring(F.col("code"), F.col("chunk") * 2 + 1, F.lit(2))), 16, 10).cast("int")
    prefix = F.shiftright(value, CHUNK - prefix_bits)
    listed = index.select("id", "code", chunk).withColumn("prefix", prefix)
    # there are at most chunks * 2 ** CHUNK buckets, whatever the input
    sizes = listed.groupBy("chunk", "prefix").count().withColumn("blocks", F.ceil(F.col("count") / ROWS).cast("int")).drop("count")
    listed = listed.join(F.broadcast(sizes), ["chunk", "prefix"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # by how much a probed prefix may differ from the query's; as many rows at most
    limit = F.get(F.array(*map(F.lit, most)), F.col("chunk"))
    flips = index.sparkSession.range(1 << prefix_bits).select(F.col("id").cast("int").alias("flip"), chunk).filter(F.bit_count("flip") <= limit)
    probes = queries.select("id", "code", chunk).withColumn("prefix", prefix).join(F.broadcast(flips), "chunk")
    probes = probes.withColumn("prefix", F.col("prefix").bitwiseXOR(F.col("flip"))).join(F.broadcast(sizes), ["chunk", "prefix"])
    probes = probes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["chunk", "prefix", "block"]
    both = listed.select(*keys, F.lit(0).alias("side"), "id", "code").union(probes.select(*keys, F.lit(1).alias("side"), "id", "code"))
    dealt = both.repartition(*keys).sortWithinPartitions(*keys, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, codes = None, [], []  # the block that queries stream past
        for b in batches:
            head = np.stack([b.column(k).to_numpy() for k in range(4)], axis=1)
            cuts = np.flatnonzero(np.r_[True, (head[1:] != head[:-1]).any(axis=1), True])
            own, code = b.column(4).to_numpy(), words(b.column(5).to_pylist(), chunks)
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                key = tuple(head[lo, :3])
                if key != at:
                    at, ids, codes = key, [], []
                if head[lo, 3] == 0:
                    ids.append(own[lo:hi])
                    codes.append(code[lo:hi])
                elif ids:
                    ids, codes = [np.concatenate(ids)], [np.concatenate(codes)]
                    for k in range(lo, hi, STEP):
                        q, v, apart = meet(int(key[0]), most, radius, code[k : min(k + STEP, hi)], codes[0])
                        if len(q):
                            yield pa.RecordBatch.from_arrays([pa.array(own[k + q]), pa.array(ids[0][v]), pa.array(apart)], names=["query_id", "id", "apart"])

    kind = index.schema["id"].dataType.simpleString()
    return dealt.mapInArrow(run, f"query_id {kind}, id {kind}, apart long")


def meet(chunk: int, most: list[int], radius: int, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs within the radius whose first chunk within its threshold is this one: places in q, in v, and the distances."""
    a, b = np.nonzero(np.bitwise_count(q[:, chunk][:, None] ^ v[:, chunk][None]) <= most[chunk])
    apart = distances(q[a], v[b])
    ok = apart <= radius
    a, b, apart = a[ok], b[ok], apart[ok]
    before = np.bitwise_count(q[a, :chunk] ^ v[b, :chunk]) <= np.array(most[:chunk], np.int64)[None]
    ok = ~before.any(axis=1)
    return a[ok], b[ok], apart[ok]


def scored(pairs: DataFrame, queries: DataFrame, index: DataFrame, dims: int) -> DataFrame:
    """(query_id, id, ids, score) of found pairs: the vectors are fetched now, for these rows only."""
    names = ["query_id", "id", "ids", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, v = matrix(b.column(3), dims), matrix(b.column(4), dims)
            q, v = q / np.abs(q).max(axis=1, keepdims=True, initial=0.0), v / np.abs(v).max(axis=1, keepdims=True, initial=0.0)
            dot = lambda x, y: np.einsum("ij,ij->i", x, y)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(dot(q, v) / (np.sqrt(dot(q, q)) * np.sqrt(dot(v, v))))], names=names)

    asked = queries.select(F.col("id").alias("query_id"), F.col("vec").alias("q"))
    both = pairs.select("query_id", "id").join(index.select("id", "ids", "vec"), "id").join(asked, "query_id").select("query_id", "id", "ids", "q", "vec")
    kind = index.schema["id"].dataType.simpleString()
    return both.mapInArrow(run, f"query_id {kind}, id {kind}, ids array<{kind}>, score double")


def first_rows(rows: DataFrame, key: str, order: list, n: int, name: str) -> DataFrame:
    """The n first rows of each key with their rank; Spark limits each task's rows before it shuffles them."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col(name) <= n)


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest found of each row for which the condition is_query holds.

    Every vector is a candidate but the query's own id; nearest by cosine first, ties to the smaller id. The radius is
    fitted on a few queries against all rows; queries that find fewer than k within it search again with wider ones, at
    last with one that all codes are in, so each gets k, or all there are. Equal vectors are indexed and searched for
    once; of their ids the k + 1 smallest can be among the nearest, and no other. Null ids and vectors that are null,
    zero or hold null or non-finite components take no part, nor do vectors of another length than the most frequent
    one. An id with several vectors is found once, by its nearest, and as a query it asks with the least of them. An
    empty table gives no rows; other columns are ignored. Integer ids are needed.
    """
    rows = valid(vectors, id_col, vec_col)
    model = fit(rows)
    if model is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("score")).limit(0)
    # equal vectors have equal keys of 128 bits
    key = F.concat_ws(":", F.xxhash64("vec"), F.xxhash64(F.lit(7), "vec"))
    keyed = rows.filter(F.size("vec") == model["dims"]).withColumn("key", key)
    if not keyed.groupBy("key", "id").count().filter("count > 1").isEmpty():
        keyed = keyed.dropDuplicates(["key", "id"])
    few = first_rows(keyed, "key", ["id"], k + 1, "n")
    once = few.groupBy("key").agg(F.first("vec").alias("vec"), F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids"))
    index = materialize(encoded(once.select("id", "ids", "vec"), model), "codes")
    wanted = vectors.filter(is_query).select(F.col(id_col).alias("id")).distinct()
    asked = rows.filter(F.size("vec") == model["dims"]).join(wanted, "id", "left_semi").groupBy("id").agg(F.min("vec").alias("vec")).withColumn("key", key)
    asked = materialize(asked, "asked")
    groups = materialize(asked.groupBy("key").agg(F.first("vec").alias("vec"), F.min("id").alias("query_id"), F.count(F.lit(1)).alias("n")), "asked-once")
    queries = materialize(encoded(groups.select(F.col("query_id").alias("id"), "vec"), model), "query-codes")
    radius, bits, step, done = fit_radius(queries, index, model, k), model["chunks"] * CHUNK, model["chunks"] // 2, None
    nearest_first = [F.desc("score"), "id"]
    while True:
        best = first_rows(scored(search(queries, index, model, radius), queries, index, model["dims"]), "query_id", nearest_first, k + 1, "n")
        ids = best.select("query_id", F.explode("ids").alias("id"), "score").groupBy("query_id", "id").agg(F.max("score").alias("score"))
        found = materialize(first_rows(ids, "query_id", nearest_first, k + 1, "n"), "neighbours")
        enough = found.filter(F.col("n") == k + 1).select("query_id")
        done_now = found if radius >= bits else found.join(enough, "query_id", "left_semi")
        done = done_now if done is None else done.unionByName(done_now)
        if radius >= bits:
            break
        queries = materialize(queries.join(enough, queries["id"] == enough["query_id"], "left_anti"), "short-queries")
        if queries.isEmpty():
            break
        radius, step = min(bits, radius + step), 2 * step
    members = join_groups(asked.select("id", "key"), groups.select("key", "query_id", "n"), "key", "n").select(F.col("id").alias("own"), "query_id")
    others = members.join(done.drop("n"), "query_id").filter(F.col("own") != F.col("id")).select(F.col("own").alias("query_id"), "id", "score")
    return first_rows(others, "query_id", nearest_first, k, "rank").select("query_id", "rank", "id", "score")
