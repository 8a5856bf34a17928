"""Centroid clustering in whole numbers, with annulus search for the nearest centroid.

Centroids are sorted by norm. By the triangle inequality a centroid within distance u of a vector has a norm within u
of the vector's, so once one distance is known, binary search gives the run of centroids that can be as near; only
those are compared, exactly. Each task sums its vectors by cluster; Spark adds up the sums, and only centroids (a fixed
number of rows) come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.session import materialize

#: Vectors that are compared at once.
ROWS = 4096
#: Whole numbers below this keep squared distances of up to DIMS components within 63 bits; others are taken as Python's integers.
SMALL, DIMS = 2**24, 2**12
#: Norms are rounded to doubles: the annulus is so much wider, relative to the norms.
SLACK = 1e-9


@dataclass(frozen=True)
class Clustering:
    """What `cluster` takes: dimensions of the vectors that take part, clusters, rounds, scale, and the salt of the starting draw."""

    dims: int = 64
    clusters: int = 16
    rounds: int = 3
    scale: int = 64
    salt: str = "1"


def whole_components(vec: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double; as a double, which holds it exactly for a scale that is a power of two."""
    return F.transform(vec, lambda x: F.lit(float(scale)) * x.cast("double"))


def taking_part(vectors: DataFrame, how: Clustering, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): vectors of exactly the dimensions, with no null or non-finite component, each component scaled (the floor is taken in the tasks)."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    ok = (F.size(v) == how.dims) & ~bad
    return vectors.filter(F.coalesce(ok, F.lit(False))).select(F.col(id_col).alias("id"), whole_components(v, how.scale).alias("vec"))


def starting_centroids(rows: DataFrame, how: Clustering) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in that order; of equal ids the smaller vector first."""
    draw = F.sha2(F.concat(F.lit(f"{how.salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = rows.select(draw.alias("draw"), "vec").orderBy("draw", "vec").limit(how.clusters).collect()
    return exact(np.floor(np.array([r["vec"] for r in first], np.float64).reshape(-1, how.dims)))


def exact(x: np.ndarray) -> np.ndarray:
    """Whole doubles as 64-bit integers, or as Python's if some are large."""
    if not x.size or (np.abs(x).max() < SMALL and x.shape[-1] <= DIMS):
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def narrow(centroids: np.ndarray) -> np.ndarray:
    """Centroids of Python's integers as 64-bit ones, if they are small."""
    if centroids.size and max(abs(int(v)) for v in centroids.ravel()) < SMALL and centroids.shape[1] <= DIMS:
        return centroids.astype(np.int64)
    return centroids


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=1)


class Annuli:
    """Centroids by norm."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance, comparisons made); of equally near ones the smaller number."""
        wide = x.dtype == object or self.centroids.dtype == object
        x, centroids = (x.astype(object), self.centroids.astype(object)) if wide else (x, self.centroids)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        # the bound: the distance to the centroid whose norm is nearest
        right = np.clip(np.searchsorted(self.norms, norm), 1, len(self.norms) - 1) if len(self.norms) > 1 else np.zeros(len(x), np.int64)
        left = np.maximum(right - 1, 0)
        close = np.where(norm - self.norms[left] <= self.norms[right] - norm, left, right)
        number = self.order[close]
        best = squared(x, centroids[number])
        bound = np.sqrt(best.astype(np.float64))
        slack = SLACK * (norm + bound + self.norms[-1]) + SLACK
        low = np.searchsorted(self.norms, norm - bound - slack, "left")
        high = np.searchsorted(self.norms, norm + bound + slack, "right")
        compared = len(x)
        for k, c in enumerate(self.order.tolist()):
            at = np.flatnonzero((low <= k) & (k < high) & (close != k))
            if not len(at):
                continue
            compared += len(at)
            d = squared(x[at], centroids[c])
            nearer = (d < best[at]) | ((d == best[at]) & (c < number[at]))
            at, d = at[nearer.astype(bool)], d[nearer.astype(bool)]
            best[at], number[at] = d, c
        return number, best, compared


def blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, whole vectors) of batches of (id, vec)."""
    for whole in batches:
        for lo in range(0, whole.num_rows, ROWS):
            b = whole.slice(lo, ROWS)
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            yield b.column(0), exact(np.floor(flat.reshape(-1, dims)))


def assigned(rows: DataFrame, centroids: np.ndarray, how: Clustering) -> DataFrame:
    """(id, cluster, distance) of every vector; a squared distance beyond 63 bits fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = Annuli(centroids)
        for ids, x in blocks(batches, how.dims):
            number, distance, _ = annuli.nearest(x)
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(distance.tolist(), pa.int64())], names=["id", "cluster", "distance"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, cluster int, distance long")


def cluster_sums(rows: DataFrame, centroids: np.ndarray, how: Clustering) -> DataFrame:
    """(cluster, n, place, total): for each cluster with vectors their number and the sum of each component. A task gives a row for each cluster and component."""
    exact_sum = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli, k = Annuli(centroids), len(centroids)
        counts, sums = [0] * k, np.zeros((k, how.dims), object)
        for _, x in blocks(batches, how.dims):
            number, _, _ = annuli.nearest(x)
            for c in np.unique(number).tolist():
                own = x[number == c]
                counts[c] += len(own)
                sums[c] += own.sum(axis=0).astype(object)
        have = [c for c in range(k) if counts[c]]
        if have:
            places = list(range(how.dims))
            cols = [[c for c in have for _ in places], [counts[c] for c in have for _ in places], places * len(have), [int(v) for c in have for v in sums[c]]]
            types = (pa.int32(), pa.int64(), pa.int32(), exact_sum)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types, strict=True)], names=["cluster", "n", "place", "total"])

    part = rows.mapInArrow(run, "cluster int, n long, place int, total decimal(38,0)")
    return part.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def moved(rows: DataFrame, centroids: np.ndarray, how: Clustering) -> np.ndarray:
    """Each centroid that has vectors becomes the floor of their mean; the others stay."""
    out = centroids.astype(object)
    for r in cluster_sums(rows, centroids, how).collect():  # clusters times dimensions, whatever the input
        out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return narrow(out)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in centroid).encode()).hexdigest()


def cluster(vectors: DataFrame, how: Clustering = Clustering(), id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((id, cluster, distance, cluster_inertia, inertia), centroids) after the rounds and a last assignment.

    Vectors that are null, of another length, or hold a null or non-finite component take no part. Rows that repeat an
    id are vectors each; a null id counts as an empty text in the starting draw. With fewer vectors than clusters each
    starts one; without any there are no centroids and no rows. Equal centroids are told by number: the smaller one
    takes all. Other columns are ignored. Sums are exact at any size; a squared distance or an inertia beyond 63 bits
    fails.
    """
    rows = taking_part(vectors, how, id_col, vec_col)
    centroids = starting_centroids(rows, how)
    kind = rows.schema["id"].dataType.simpleString()
    if not len(centroids):
        empty = rows.sparkSession.createDataFrame([], f"id {kind}, cluster int, distance long, cluster_inertia long, inertia long")
        return empty, centroids
    for _ in range(how.rounds):
        centroids = moved(rows, centroids, how)
    found = materialize(assigned(rows, centroids, how), "clusters")
    own = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    all_ = own.agg(F.sum("s").cast("long").alias("inertia"))
    sums = own.select("cluster", F.col("s").cast("long").alias("cluster_inertia")).crossJoin(F.broadcast(all_))  # one row on the right
    return found.join(F.broadcast(sums), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia"), centroids


def with_digests(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """found with centroid_sha256, the SHA-256 of its centroid's components as decimal numbers joined by commas."""
    names = F.array(*[F.lit(digest(c)) for c in centroids]) if len(centroids) else F.array(F.lit(None).cast("string"))
    return found.withColumn("centroid_sha256", F.get(names, F.col("cluster")))
