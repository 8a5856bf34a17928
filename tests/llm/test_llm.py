"""The operators against brute force, round trips and held-out labels, and their corner cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from peakloom.llm import common, exact_dedup, graph, language_id, minhash, mixing, multi_index, quality, secret_scan, sentencepiece_bpe, suffix_dedup, warc
from peakloom.llm.queries import QUERIES
from peakloom.session import materialize, scratch_path

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
#: Extra columns whose names operators use inside, nulls, empty, repeated and very long texts.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, digest string, tokens int, ids string"
LONG = "word " * 40_000 + "end"
ODD = [
    (1, None, None, None, None, 5, "x", 1, "y"), (2, "", "en", "a", 0, 5, "x", 1, "y"), (3, "Same Text here now", "en", "a", 0, 5, "x", 1, "y"),
    (4, "same text HERE now", "en", None, 0, 5, None, 1, "y"), (5, LONG, "en", "a", 0, 5, "x", None, "y"), (6, LONG, "fr", "b", 0, None, "x", 1, None),
    (7, "été à Paris\n\n  déjà", "fr", "b", 0, 5, "x", 1, "y"), (7, "été à Paris\n\n  déjà", "fr", "b", 0, 5, "x", 1, "y"), (None, "no id", "en", "b", 0, 5, "x", 1, "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# shared


def test_least_rows(spark):
    rows = spark.range(20_000).selectExpr("id", "CASE WHEN id % 5000 = 1 THEN 'few' WHEN id % 4 = 0 THEN NULL ELSE 'many' END AS key", "xxhash64(id) AS draw")
    rows = rows.unionByName(spark.range(500).selectExpr("-1L AS id", "'same' AS key", "7L AS draw"))
    got = common.least_rows(rows, "key", "draw", 50, ["id"]).toPandas()
    d = rows.toPandas().fillna("null").sort_values(["draw", "id"])
    for key, own in d.groupby("key"):
        want = own.head(50)
        have = got[got.key.fillna("null") == key].sort_values("k")
        assert have.draw.tolist() == want.draw.tolist() and have.k.tolist() == list(range(1, len(want) + 1)), key
    assert common.least_rows(rows.limit(0), "key", "draw", 5, ["id"]).count() == 0


def test_budgets_take_whole_rows(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 4), ("a", 3, 100), ("a", 4, 1), ("b", 1, 1000), ("b", 2, 1), (None, 1, 3)], "key string, k int, size int")
    got = {(r["key"], r["k"]) for r in common.within_budget(rows, "key", F.col("size"), 10).collect()}
    assert got == {("a", 1), ("a", 2), ("a", 3), ("b", 1), (None, 1)}


def test_release(spark):
    table = materialize(spark.range(5), "kept")
    folder = table.inputFiles()[0].rpartition("/")[0]
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert store.exists(at)
    common.release(table)
    assert not store.exists(at)


# 1 exact dedup


def test_exact_dedup_corners(odd, none):
    got = {r["id"]: r for r in exact_dedup.exact_dedup(odd).collect()}
    assert len(got) == 8 and got[1]["keep_id"] == 2 and got[1]["group_size"] == 2 and not got[1]["kept"]
    assert got[3]["keep_id"] == 4 and got[5]["keep_id"] == 6 and got[7]["kept"] and got[7]["group_size"] == 1 and got[None]["kept"]
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.kept_documents(odd)
    assert kept.columns == odd.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([2, 4, 6, 7, None])


def test_index_is_persistent(spark, odd):
    index = exact_dedup.fresh_index(spark)
    rows = exact_dedup.digests(odd).distinct()
    index.append(exact_dedup.groups_of(rows.filter("id <= 3")))
    before = index.read().count()
    again = exact_dedup.exact_dedup(odd, index=index)
    got = {r["id"]: r for r in again.collect()}
    assert got[4]["keep_id"] == 3 and index.read().count() == before + 3
    plan = index.unseen(exact_dedup.groups_of(rows))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


# 2 mixing


def test_mixing_meets_the_limit(spark, docs):
    skewed = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.col("source")))
    used = mixing.mix(skewed, max_repetition=2.0).toPandas()
    texts = skewed.select("doc_id", "source", "text").toPandas()
    texts["n"] = texts.text.fillna("").str.split().str.len()
    have, take = texts.groupby("source").n.sum(), used.groupby("source").tokens.sum()
    share = have / have.sum()
    # brute force: the least alpha with the largest over the smallest repetition within the limit
    alpha = 1 - np.log(2.0) / np.log(share.max() / share.min())
    epochs = share ** (alpha - 1) / (share ** (alpha - 1)).min()
    most = texts.groupby("source").n.max()
    assert set(used.id) == set(texts.doc_id)
    assert ((take - epochs * have).abs() <= most + 2).all()
    assert used.position.is_unique
    first = used[used["pass"] == 0]
    mixed = [r["doc_id"] for r in mixing.mixed_documents(skewed, 2.0).select("doc_id").collect()]
    assert len(first) == len(texts) and mixed == used.sort_values("position", kind="stable").id.tolist()


def test_mixing_entropy_and_budget(spark, docs):
    shares = spark.createDataFrame([(0.9,), (0.05,), (0.05,)], "share double")
    alpha = mixing.find_alpha(shares, target_entropy=0.8)
    w = np.array([0.9, 0.05, 0.05]) ** alpha
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - 0.8) < 1e-4
    assert mixing.find_alpha(shares, target_entropy=0.1) == 1.0 and mixing.find_alpha(shares, target_entropy=5.0) == 0.0
    used = mixing.mix(docs, target_entropy=2.9, budget=20_000).toPandas()
    assert 0.5 * 20_000 <= used.tokens.sum() <= 20_000


def test_mixing_corners(odd, none):
    assert mixing.mix(none, max_repetition=2.0).count() == 0
    used = mixing.mix(odd, max_repetition=1.0).toPandas()
    assert len(used) == len(ODD)
    assert mixing.mixed_documents(odd, 1.0).columns == odd.columns


# 3 sentencepiece


def test_sentencepiece_is_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    random.seed(1)
    letters = "ab▁ \n.eéthisnog日😀=-  "
    texts = ["", " ", "\n", "  a  b\n \n x ", "▁x▁▁", "a" * 300, "日本語😀é", "<s></s><0x0A><unk>", "\x00\x01", "thethethe the", " " * 50, LONG[:5000]]
    texts += ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(2000)]
    model = sentencepiece_bpe.load(MODEL)
    ids, at = sentencepiece_bpe.Encoder(model).encode(texts)
    want = sp.encode(texts)
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == want
    assert sentencepiece_bpe.decode(model, ids, at) == [sp.decode(w) for w in want]


def test_sentencepiece_on_tables(spark, odd, none, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for table in (odd, docs):
        got = sentencepiece_bpe.round_trip(table, MODEL).collect()
        want = Counter((r["doc_id"], tuple(sp.encode(r["text"] or ""))) for r in table.collect())
        assert Counter((r["id"], tuple(r["ids"])) for r in got) == want
        assert all(r["text"] == sp.decode(r["ids"]) for r in got)
    assert sentencepiece_bpe.round_trip(none, MODEL).count() == 0
    two = sentencepiece_bpe.decode_ids(sentencepiece_bpe.encode_texts(odd, MODEL), MODEL)
    assert {r["id"]: r["text"] for r in two.collect()}[3] == "Same Text here now"


# 4 repeated substrings


def brute_cut(texts):
    w, seen = suffix_dedup.WINDOW, Counter()
    datas = [(t or "").encode() for t in texts]
    for d in datas:
        seen.update(d[k : k + w] for k in range(len(d) - w + 1))
    out = []
    for d in datas:
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - w + 1):
            if seen[d[k : k + w]] > 1:
                gone[k : k + w] = True
        out.append((len(d), int(gone.sum()), np.frombuffer(d, np.uint8)[~gone].tobytes()))
    return out


def planted():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, periodic = prose(120), "xyz " * 300
    texts = [prose(rng.randint(1, 200)) for _ in range(20)]
    texts += [prose(30) + passage + prose(20), passage[7:], prose(5) + passage[:420] + "é" + passage[420:], passage[:399], passage[:400]]
    texts += [prose(10) + periodic, "xyz " * 110, "a" * 1500, prose(40) + passage + prose(3) + passage, texts[0] * 3, None, ""]
    return texts


def test_suffix_dedup_is_brute_force(spark):
    texts = planted()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r for r in suffix_dedup.drop_repeats(df).collect()}
    for k, (n, removed, kept) in enumerate(brute_cut(texts)):
        r = got[k]
        assert (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), bytes(r["kept"])) == (n, removed, kept), k
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_suffix_dedup_hot_minimizers(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_PIECES", 1)
    test_suffix_dedup_is_brute_force(spark)


def test_suffix_dedup_beyond_a_span(spark):
    """Texts longer than a span: passages across its border, in it twice, and in another text."""
    rng, span = random.Random(12), suffix_dedup.SPAN
    noise = lambda n: rng.randbytes(n // 2).hex()
    passage, other = noise(1000), noise(600)
    a = noise(span - 500) + passage + noise(5000) + other + noise(span - 100) + passage[:500] + noise(300)
    b = noise(777) + other + noise(span - 1800) + passage + noise(20)
    want = [[(a.index(passage), 1000), (a.index(other), 600), (a.rindex(passage[:500]), 500)], [(b.index(other), 600), (b.index(passage), 1000)]]
    got = suffix_dedup.drop_repeats(spark.createDataFrame([(0, a), (1, b)], "doc_id long, text string"), kept_bytes=False).orderBy("id").collect()
    for r, spans in zip(got, want, strict=True):
        # a passage may go on by a few characters that happen to be alike
        assert [abs(s["start"] - at) + abs(s["end"] - s["start"] - n) < 8 for s, (at, n) in zip(r["spans"], spans, strict=True)].count(False) == 0


def test_suffix_dedup_corners(odd, none):
    got = suffix_dedup.drop_repeats(odd).collect()
    assert len(got) == len(ODD) - 1
    by = {r["id"]: r for r in got}
    assert by[5]["kept"] == b"" and by[6]["kept"] == b"" and by[1]["n_bytes"] == 0 and bytes(by[None]["kept"]) == b"no id"
    assert suffix_dedup.drop_repeats(none).count() == 0


def test_merged_order_is_the_suffix_order():
    rng = np.random.default_rng(1)
    pieces = [rng.integers(1, 4, rng.integers(1, 30)) for _ in range(12)]
    words = np.concatenate([np.r_[p, 0] for p in pieces])
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    orders, transforms, base = [], [], [0]
    for lo, hi in ((0, 4), (4, 9), (9, 12)):
        a, b = (ends[lo - 1] + 1 if lo else 0), ends[hi - 1] + 1
        order, before = suffix_dedup.shard_transform(words[a:b], ends[lo:hi] - a)
        orders.append(order + a)
        transforms.append(before)
    shard, row, common = suffix_dedup.merge_transforms(transforms, 49)
    base = np.cumsum([0] + [len(o) for o in orders[:-1]])
    start = np.concatenate(orders)[base[shard] + row]
    suffix = lambda s: tuple(words[s : ends[np.searchsorted(ends, s)]].tolist())
    got = [suffix(s) for s in start]
    assert got == sorted(got)
    for k in range(1, len(got)):
        n = 0
        while n < min(len(got[k]), len(got[k - 1])) and got[k][n] == got[k - 1][n]:
            n += 1
        assert common[k] == n


# 5 secrets


def test_secret_base_is_brute_force(spark, docs):
    extra = spark.createDataFrame([(-1, "API_KEY='abcdef123' secret:token:abcdefg Password = \"xy\" AKIA" + "A1" * 9 + " x" + "0f" * 12 + " paſſword=abcdefgh 😀token=1234567"), (-2, None), (-3, "")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(extra)
    got = {r["id"]: r["secrets"] for r in secret_scan.scan_documents(rows).collect()}
    for r in rows.collect():
        t = r["text"] or ""
        want = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        want += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        want.sort(key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))
        assert [(s["kind"], s["start"], s["end"]) for s in got[r["doc_id"]] if s["kind"] != "guess"] == want
    assert [t.kind for t in got[-1]].count("assign") == 2 and got[-2] == [] and got[-3] == []


def test_guess_cost():
    assert secret_scan.guess_cost("") == 0 and secret_scan.guess_cost("password") < 1 and secret_scan.guess_cost("aaaaaaaaaaaa") < 4
    assert secret_scan.guess_cost("qwertyuiop") < 4 and secret_scan.guess_cost("19991231") < 6 and secret_scan.guess_cost("zX9#kq2LmP7v") > 10
    by_hand = min(secret_scan.char_cost("x") + secret_scan.guess_cost("password"), secret_scan.guess_cost("xpassword"))
    assert secret_scan.guess_cost("xpassword") == by_hand
    assert [k for _, k, _ in secret_scan.scan("pwd: zX9#kq2LmP7v and pwd: password1")] == [3]
    # a repeated block costs its block and its length, so it is no secret; a long value without structure is one
    assert secret_scan.scan("pwd=" + "q7" * 5000) == []
    drawn = random.Random(4)
    value = "".join(drawn.choices("bcdfghjkmnpqrstvwxz2346789#!", k=10_000))
    assert secret_scan.scan("pwd=" + value) == [(4, 3, 10_004)]


def test_secret_corners(odd, none):
    assert secret_scan.scan_documents(odd).count() == len(ODD) and secret_scan.scan_documents(none).count() == 0


# 6 WARC


def test_warc_round_trip(spark, tmp_path):
    html = "<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</p>"
    rows = [(1, "http://a/x y", html, "e"), (2, "http://b", html, "e"), (3, None, None, "e"), (4, "http://c", "", "e"), (5, "http://d/q?é", "é" * 3, "e"), (5, "http://d/q?é", "é" * 3, "e"), (None, "http://e", "solo", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = warc.archive_pages(pages, str(tmp_path / "warc")).collect()
    by = {r["metadata"]["fields"].get("capture-id"): r for r in got}
    assert len(got) == 6 and bytes(by["1"]["response"]["payload"]).decode() == html and by["2"]["response"]["record_type"] == "revisit"
    assert by["2"]["metadata"]["fields"]["refers-to-capture"] == "1" and by["4"]["response"]["record_type"] == "revisit" and by["3"]["response"]["payload_bytes"] == 0
    assert all(r["request"]["uri"] == r["response"]["uri"] for r in got)
    assert all(r["response"]["computed_digest"] in (None, r["response"]["payload_digest"]) for r in got)
    few = warc.plan_captures(pages, least_bytes=10).filter("first_id is not null").collect()
    assert [r["id"] for r in few] == [2]
    assert warc.archive_pages(pages.limit(0), scratch_path(spark, "warc")).count() == 0


# 7 language


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_language_id"](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/documents.parquet"), on="doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_network_is_a_convolution_with_its_gradient():
    """Log probabilities against a convolution written out, and a step of training against numeric gradients."""
    rng = np.random.default_rng(1)
    net = language_id.Network(3, seed=2)
    x, y = rng.integers(0, 256, (5, 40)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def naive(net):
        out = []
        for row in x:
            h = []
            for f in range(net.n):
                width = language_id.WIDTHS[f // language_id.FILTERS]
                w = net.filters[:, f].reshape(net.wide, language_id.EMBED)[:width].astype(np.float64)
                acts = [(net.embed[row[k : k + width]] * w).sum() for k in range(40 - net.wide + 1)]
                h.append(max(max(acts) + net.bias[f], 0.0))
            z = np.array(h) @ net.out + net.out_bias
            out.append(z - np.log(np.exp(z).sum()))
        return np.array(out)

    assert np.allclose(net.log_probabilities(x), naive(net), atol=1e-4)
    loss = lambda: -naive(net)[np.arange(5), y].mean()
    grads = net.gradients(x, y)
    for name in ("embed", "filters", "bias", "out", "out_bias"):
        flat, g = getattr(net, name).reshape(-1), grads[name].reshape(-1)
        for at in np.argsort(-np.abs(g))[:4]:
            was = flat[at]
            flat[at] = was + 1e-3
            up = loss()
            flat[at] = was - 1e-3
            down = loss()
            flat[at] = was
            assert g[at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-4), name


def test_language_corners(odd, none):
    model = language_id.fit(odd)
    got = language_id.predict(odd.union(odd.limit(1).selectExpr("99L", "'123 !'", *odd.columns[2:])), model).collect()
    by = {r["id"]: r for r in got}
    assert len(got) == len(ODD) + 1 and by[1]["lang_pred"] == "und" and by[2]["lang_pred"] == "und" and by[99]["lang_pred"] == "und" and by[3]["lang_pred"] in ("en", "fr")
    assert language_id.predict(none, model).count() == 0
    empty = language_id.fit(none)
    assert {r["lang_pred"] for r in language_id.predict(odd, empty).collect()} == {"und"}


# 8 nearest neighbours


def test_neighbours_recall_and_scores(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = multi_index.nearest(vectors, F.col("vec_id") % 50 == 0).toPandas()
    d = vectors.toPandas().sort_values("vec_id")
    x, ids = np.array(d.embedding.tolist(), np.float64), d.vec_id.to_numpy()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q, own in got.sort_values("rank").groupby("query_id"):
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        hits += len(set(ids[np.lexsort((ids, -s))[:5]]) & set(own["id"]))
        total += 5
        at = np.searchsorted(ids, own["id"])
        assert np.allclose(own.score, s[at], atol=1e-12) and own["rank"].tolist() == [1, 2, 3, 4, 5]
    assert hits / total >= 0.9


def test_neighbours_corners(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, []), (None, [1.0, 1.0]), (10, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("code", F.lit(1))
    got = multi_index.nearest(df, F.col("vec_id") == 0, k=5).collect()
    assert [(r["rank"], r["id"], round(r["score"], 9)) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 1.0), (2, 2, 1.0), (3, 10, -1.0)]
    assert multi_index.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("radius", [9, 90, 256])
def test_every_code_within_the_radius_is_found(spark, monkeypatch, radius):
    monkeypatch.setattr(multi_index, "ROWS", 32)
    monkeypatch.setattr(multi_index, "STEP", 7)
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(200, 16)), 2, axis=0) + 0.02 * rng.normal(size=(400, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<double>")
    model = multi_index.fit(df)
    index = materialize(multi_index.encoded(df, model), "codes")
    codes = multi_index.words([bytes(r["code"]) for r in index.orderBy("id").collect()], model["chunks"])
    apart = multi_index.distances(codes[:, None], codes[None])
    got = multi_index.search(index.filter("id < 20"), index, model, radius).collect()
    assert Counter((r["query_id"], r["id"], r["apart"]) for r in got) == Counter((q, v, apart[q, v]) for q in range(20) for v in range(400) if apart[q, v] <= radius)
    assert sum(multi_index.thresholds(radius, model["chunks"])) == radius + 1 - model["chunks"] and len(got) > 20


def test_copies_scales_and_ties(spark):
    """A third of all rows are one vector; ids come several times; every query has its 5 nearest by brute force."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8)).round(3)
    x[::3] = x[0]
    x[1::30] *= 4.0
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows + rows[:40] + [(7, x[9].tolist())], "vec_id long, embedding array<double>")
    got = multi_index.nearest(df, F.col("vec_id") % 5 == 0).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, own in got.sort_values("rank").groupby("query_id"):
        score = u @ u[q]
        best = score.copy()
        best[7] = max(best[7], score[9])
        best[q] = -9
        order = np.lexsort((np.arange(300), -best.round(12)))[:5]
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(own.score, best[own["id"]], atol=1e-12)
        assert q % 3 or own["id"].tolist() == order.tolist()
        hits += len(set(order) & set(own["id"]))
    assert hits >= 0.9 * 5 * 60 and got.query_id.nunique() == 60


def test_close_neighbours_take_few_comparisons(spark):
    """Where neighbours are near, the chunks hold few candidates: what is looked at is a small share of all pairs."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(700, 32)), 6, axis=0) + 0.05 * rng.normal(size=(4200, 32))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<double>")
    model = multi_index.fit(df)
    index = materialize(multi_index.encoded(df, model), "codes")
    radius = multi_index.fit_radius(index, index, model, 5)
    codes = multi_index.words([bytes(r["code"]) for r in index.orderBy("id").collect()], model["chunks"])
    q, most = codes[:100], multi_index.thresholds(radius, model["chunks"])
    looked = sum((np.bitwise_count(q[:, c][:, None] ^ codes[:, c][None]) <= most[c]).sum() for c in range(model["chunks"]))
    assert looked < 0.1 * len(q) * len(codes)
    ranked = (multi_index.distances(q[:, None], codes[None]) <= radius).sum()
    assert ranked < 0.01 * len(q) * len(codes)


# 9 near duplicates


def brute_components(texts, width, percent):
    word, sets = re.compile(r"[^\x20\x09-\x0D]+"), {}
    for i, t in texts:
        w = word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = []
    for _ in range(6):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(15):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    return list(enumerate(texts + [None, "", " \t", "one two", "ONE  two"]))


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_are_brute_force(spark, width):
    texts = near_copies()
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, width=width).collect()}
    assert got == brute_components(texts, width, 80)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 4)
    test_near_duplicates_are_brute_force(spark, 4)


def test_all_pairs_within_the_distance_meet(spark):
    rng = np.random.default_rng(4)
    slots = rng.integers(0, 1 << 16, (60, minhash.SLOTS)).astype(np.uint16)
    for k in range(1, 60, 2):
        slots[k] = slots[k - 1]
        at = rng.choice(minhash.KEY_SLOTS, minhash.DISTANCE, replace=False)
        slots[k, at] ^= 1
    keys = minhash.keys_of(slots[:, : minhash.KEY_SLOTS])
    assert all(set(keys[k]) & set(keys[k - 1]) for k in range(1, 60, 2))


def test_near_duplicate_corners(odd, none):
    got = {r["id"]: r for r in minhash.near_duplicates(odd).collect()}
    assert len(got) == 8 and got[3]["component_id"] == 3 == got[4]["component_id"] and got[6]["component_id"] == 5 and got[1]["component_id"] == 1 and got[2]["kept"] and got[None]["component_id"] is None
    assert minhash.near_duplicates(none).count() == 0
    kept = minhash.kept_documents(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 5, 7, None}


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 330)]
    parent = defaultdict(lambda: None)

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for e in edges if e[0] != e[1] for i in e}


# 10 quality


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op10_quality"](spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    good, bad = held[held.quality == 1], held[held.quality == 0]
    assert (held.predicted == held.quality).mean() > 0.95 and good.predicted.mean() > 0.98 and bad.predicted.mean() < 0.2


def test_quality_difference_is_brute_force(spark, docs):
    """Scores follow from the sizes of whole blocks under the two dictionaries; long labelled texts take part in the fit."""
    import zstandard

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    long = docs.limit(1).selectExpr("990001L AS doc_id", "repeat('plain words of a long text ', 9000) AS text", *docs.columns[2:])
    model = quality.fit(docs.unionByName(long), labels.unionByName(spark.createDataFrame([(990001, 1, 0)], labels.schema)))
    options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False, "level": quality.LEVEL}
    good, bad = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(model[k]), **options) for k in ("good", "bad"))
    for r in quality.score(docs, model).join(docs.select(F.col("doc_id").alias("id"), "text"), "id").collect():
        data = (r["text"] or "").encode()
        sizes = sum(len(bad.compress(data[k : k + 1024])) - len(good.compress(data[k : k + 1024])) for k in range(0, len(data), 1024))
        x = (sizes + 100 * model["average"]) / (len(data) + 100)
        assert r["difference"] == pytest.approx(x) and r["score"] == pytest.approx(1 / (1 + np.exp(-model["intercept"] - model["slope"] * x)))


def test_quality_corners(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (5, None), (6, 0), (None, 1), (77, 0)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    got = quality.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(none, model).count() == 0
    flat = quality.fit(none, labels)
    assert {r["score"] for r in quality.score(odd, flat).collect()} == {0.5}
    kept = quality.kept_documents(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r["score"] >= quality.KEEP_SCORE for r in got)


# pipeline


def test_pipeline_stages(spark, docs):
    stage = docs
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = scratch_path(spark, "stage")
        f(spark, stage, SF).write.parquet(path)
        before, stage = stage, spark.read.parquet(path)
        if k < 4:
            assert stage.columns == docs.columns
        have, had = {r["doc_id"] for r in stage.select("doc_id").collect()}, {r["doc_id"]: r["text"] for r in before.select("doc_id", "text").collect()}
        assert have <= had.keys()
        if k == 1:
            fold = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
            largest = {}
            for i, t in had.items():
                largest[fold(t)] = max(i, largest.get(fold(t), i))
            assert have == set(largest.values())
        if k == 2:
            assert have == {i for i, (_, c) in brute_components(had.items(), 5, 80).items() if i == c}
        if k == 3:
            assert have == had.keys()
        if k == 4:
            sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
            for r in stage.collect():
                assert r["ids"] == sp.encode(had[r["doc_id"]])
                assert r["decoded_sha256"] == hashlib.sha256(sp.decode(r["ids"]).encode()).hexdigest()
