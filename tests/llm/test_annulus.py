"""Centroid clustering against a written-out k-means in Python's integers, ties, odd vectors and empty tables."""

import hashlib
import math

import numpy as np
import pytest

from peakloom.llm import annulus

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, id string, distance long"


def brute(rows: list[tuple], how: annulus.Clustering):
    """{(id, vector): (cluster, distance)}, inertia of each cluster, centroids."""
    kept = [(i, tuple(math.floor(how.scale * float(np.float32(x))) for x in v)) for i, v in rows if v is not None and len(v) == how.dims and all(x is not None and math.isfinite(x) for x in v)]
    draw = sorted(kept, key=lambda r: (hashlib.sha256(f"{how.salt}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in draw[: how.clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(how.rounds):
        own: dict[int, list] = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        for k, vs in own.items():
            centroids[k] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    return sorted((str(i), *near(v)[::-1]) for i, v in kept), centroids


def check(spark, rows, how):
    table = spark.createDataFrame([(i, v, 1, 9, "x", 5) for i, v in rows], SCHEMA).repartition(3)
    found, centroids = annulus.cluster(table, how)
    got = annulus.with_digests(found, centroids).collect()
    want, want_centroids = brute(rows, how)
    assert sorted((str(r["id"]), r["cluster"], r["distance"]) for r in got) == want
    assert centroids.tolist() == want_centroids
    inertia: dict[int, int] = {}
    for _, c, d in want:
        inertia[c] = inertia.get(c, 0) + d
    for r in got:
        assert r["cluster_inertia"] == inertia[r["cluster"]] and r["inertia"] == sum(inertia.values())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, want_centroids[r["cluster"]])).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    how = annulus.Clustering(dims=5, clusters=7, rounds=3)
    x = rng.normal(size=(300, 5)) * (0.05 if seed == 1 else 1)  # small vectors tie often
    x[200:] = x[:100]
    check(spark, [(k, v) for k, v in enumerate(x.astype(np.float32).tolist())], how)


def test_odd_vectors(spark):
    how = annulus.Clustering(dims=3, clusters=4, rounds=2)
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, 2.0]), (4, [1.0, None, 2.0]), (5, [nan, 1.0, 1.0]), (6, [inf, 1.0, 1.0]), (7, [0.0, 0.0, 0.0]), (7, [0.0, 0.0, 0.0]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (8, [-0.01, 0.01, -1e-30]), (9, [1.0, 1.0, 1.0])]
    check(spark, rows, how)
    check(spark, rows[:9], annulus.Clustering(dims=3, clusters=16, rounds=2))  # fewer vectors than clusters, equal centroids
    assert annulus.cluster(spark.createDataFrame([], SCHEMA))[0].count() == 0
    assert annulus.with_digests(*annulus.cluster(spark.createDataFrame([], SCHEMA))).columns[-1] == "centroid_sha256"


def test_large_components(spark):
    rows = [(k, [1e6 * k, -3e5 * k, float(k)]) for k in range(40)]
    check(spark, rows, annulus.Clustering(dims=3, clusters=5, rounds=3))


def test_annuli_leave_centroids_out():
    rng = np.random.default_rng(3)
    norms = 100 * 1.5 ** np.arange(16)
    centroids = np.floor(rng.normal(size=(16, 8)) * norms[:, None]).astype(np.int64)
    x = np.repeat(centroids, 50, axis=0) + rng.integers(-5, 6, (800, 8))
    number, distance, compared = annulus.Annuli(centroids).nearest(x)
    all_pairs = ((x[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (number == all_pairs.argmin(axis=1)).all() and (distance == all_pairs.min(axis=1)).all()
    assert compared < 0.5 * all_pairs.size


def test_ties_go_to_the_smaller_number():
    centroids = np.array([[4, 0], [-4, 0], [0, 4], [4, 0]], np.int64)
    number, distance, _ = annulus.Annuli(centroids).nearest(np.array([[0, 0], [4, 0], [-1, 5]], np.int64))
    assert number.tolist() == [0, 0, 2] and distance.tolist() == [16, 0, 2]
