"""Collocations against counting in Python, suffix arrays against sorting, odd and empty tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peakloom.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, phrase string, a long, n string, rank long"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def brute(rows: list[tuple], most: int, least: int, listed: int) -> set:
    f: dict[str, Counter] = defaultdict(Counter)
    n: Counter = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = set()
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:listed], 1):  # noqa: E741
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return out


def got(spark, rows, **how):
    table = spark.createDataFrame([(k, t, g, "x", 1, "y", 2) for k, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    return [tuple(r) for r in co.collocations(table, **how).collect()]


def sample(seed: int, words: int, docs: int) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["a", "B", "été", "na x", "日本", "x" * 300, "İ", "cd", "e"][:words]
    return [("".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\r\n", " \x0b"]) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None, "und", ""])) for _ in range(docs)]


@pytest.mark.parametrize(("seed", "words", "least", "listed"), [(1, 3, 3, 2000), (2, 9, 2, 5), (3, 5, 1, 40), (4, 2, 8, 2000)])
def test_against_counting(spark, seed, words, least, listed):
    rows = sample(seed, words, 60)
    found = got(spark, rows, least=least, listed=listed)
    assert len(found) == len(set(found)) and set(found) == brute(rows, 5, least, listed)


def test_small_shards(spark, monkeypatch):
    rows = sample(5, 6, 40) + [("word " * 3000, "en")]
    monkeypatch.setattr(co, "SHARD_BYTES", 200)
    shards = list(co.shards([pa.record_batch([pa.array([g or "und" for _, g in rows]), pa.array([t for t, _ in rows])], names=["lang", "text"])]))
    assert len(shards) > 10 and sum(len(s.word) for s in shards) == sum(len(re.findall("[^ \t.,;:!?\n-\r]+", t)) for t, _ in rows)


def test_odd_tables(spark):
    rows = [(None, None), ("", "en"), (" \t. ", "en"), ("One two", "en"), ("one TWO", "en"), ("one two", None), ("İ i", "en"), ("a a a a", "de"), ("... b", "de")]
    assert set(got(spark, rows, least=2)) == brute(rows, 5, 2, 2000)
    assert got(spark, rows) == [] and got(spark, []) == []


def test_ties_by_bytes(spark):
    rows = [("z é. z ﬀ. z 𝒳. a b", "en")] * 3
    assert [r[2] for r in sorted(got(spark, rows, least=3), key=lambda r: r[1])] == [p[2] for p in sorted(brute(rows, 5, 3, 2000), key=lambda r: r[1])]


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_suffix_order(depth):
    rng = np.random.default_rng(depth)
    word, last = rng.integers(0, 3, 500), rng.random(500) < 0.1
    last[-1] = True
    left = co.until(last)
    suffix = lambda i: tuple(word[i : i + min(depth, left[i])])
    order = co.suffix_order(word, left, depth)
    if depth in (1, 2):
        assert [suffix(i) for i in order] == sorted(map(suffix, range(500)))
    counts = Counter(suffix(i) for i in range(500) if left[i] >= depth)
    for n, at, c in co.ngrams(word, left, range(1, depth + 1)):
        if n == depth:
            assert {suffix(i): k for i, k in zip(at, c, strict=True)} == counts


def test_hashes_agree_between_shards():
    words = [b"", b"a", b"ab", b"ba", "日本".encode(), b"x" * 500]
    one = co.hashes(pa.array(words, pa.large_binary()))
    two = co.hashes(pa.array(words[::-1], pa.large_binary()))[::-1]
    assert (one == two).all() and len(set(one.tolist())) == len(words)
    assert (co.hashes(pa.array([b"zz", *words], pa.large_binary()).slice(1)) == one).all()
    bits = np.zeros(1024, np.uint64)
    assert not co.passing(bits, one).any() and co.passing(~bits, one).all()


def test_shards_of_a_task_are_added_up(monkeypatch):
    monkeypatch.setattr(co, "MERGE_ROWS", 6)
    row = lambda p, c: pa.record_batch([pa.array(["en"]), pa.array([p]), pa.array([1], pa.int32()), pa.array([c], pa.int64())], names=["lang", "phrase", "words", "c"])
    phrases = list("abababababcdefghijkaab")
    out = list(co.combined(row(p, k) for k, p in enumerate(phrases)))
    total = Counter()
    for k, p in enumerate(phrases):
        total[p] += k
    got = Counter()
    for b in out:
        for p, c in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
            got[p] += c
    assert got == total and sum(b.num_rows for b in out) < len(phrases)


def test_phrases_of_rare_triples_stay_in_their_tasks(spark):
    # all pairs of neighbours are frequent, hardly a triple is
    rng = random.Random(7)
    after = {w: rng.sample(range(40), 3) for w in range(40)}
    texts = []
    for _ in range(300):
        w = [rng.randrange(40)]
        for _ in range(29):
            w.append(rng.choice(after[w[-1]]))
        texts.append(" ".join(f"w{k}" for k in w))
    least = 40
    rows = co.rows_of(spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").coalesce(1), "text", "lang")
    frequent = co.hash_counts(rows).groupBy("hash").agg(F.sum("c").alias("c")).filter(F.col("c") >= least).select("hash")
    triples = co.hash_counts(rows, co.filter_bits(frequent)).groupBy("hash").agg(F.sum("c").alias("c")).filter(F.col("c") >= least).select("hash")
    out = co.phrase_counts(rows, co.filter_bits(frequent.union(triples)), 5).filter("words > 2").collect()
    counts = Counter()
    for t in texts:
        w = t.split()
        counts.update(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    assert sum(c >= least for c in counts.values()) == triples.count() > 0
    often = {" ".join(p) for p, c in counts.items() if c >= least}
    assert {r["phrase"] for r in out if r["words"] == 3} == often
    assert all(" ".join(r["phrase"].split()[i : i + 3]) in often for r in out for i in range(r["words"] - 2))
    assert {tuple(r) for r in co.collocations(spark.createDataFrame([(t, "en") for t in texts], "text string, lang string"), least=least).collect()} == brute([(t, "en") for t in texts], 5, least, 2000)


@pytest.mark.parametrize("most", [2, 3, 4])
def test_shorter_phrases_against_counting(spark, most):
    rows = sample(11, 3, 60)
    assert set(got(spark, rows, most_words=most, least=3)) == brute(rows, most, 3, 2000)


def test_tasks_take_several_splits(spark):
    cores = spark.sparkContext.defaultParallelism
    for n, want in ((1, 1), (2 * cores, 2 * cores), (6 * cores, 2 * cores), (32 * cores, 4 * cores)):
        rows = spark.range(0, 1000, 1, n)
        found = co.gathered(rows)
        assert found.rdd.getNumPartitions() == want and found.count() == 1000
    texts = spark.createDataFrame([(f"a b c d{k % 2}", "en") for k in range(400)], "text string, lang string").repartition(32 * cores)
    rows = co.rows_of(texts, "text", "lang")
    every = co.filter_bits(spark.range(0).select(F.col("id").alias("hash"))) | ~np.uint64(0)
    assert co.phrase_counts(co.gathered(rows), every, 5).filter("phrase = 'a b c'").count() <= 4 * cores
