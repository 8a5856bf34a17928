"""Byte-level BPE against the tiktoken library: tables, random words, long words, odd and empty tables."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from peakloom.llm import byte_bpe
from peakloom.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, id long, ids string, word int, block string, number int"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def round_trip(spark, texts, **how):
    table = spark.createDataFrame([(k, t, "en", 7, "x", 1, "y", 2) for k, t in enumerate(texts)], SCHEMA).repartition(3)
    rows = byte_bpe.decode_ids(byte_bpe.encode_texts(table, PATH, PATTERN, with_bytes=True, **how), PATH).collect()
    assert sorted(r["id"] for r in rows) == list(range(len(texts)))
    for r in rows:
        assert bytes(r["ids_bytes"]) == np.array(r["ids"], "<u4").tobytes()
    return {r["id"]: (r["ids"], bytes(r["bytes"])) for r in rows}


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op11_byte_bpe"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()


def test_odd_texts(spark, library):
    rng = random.Random(4)
    signs = ["a", "e", "th", "ing", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "日本", "😀", "́", "0", "12", "-", "==", "\x00", "\x1c", " ", " ", "ﬀ", "Ω", "�", "и"]
    texts = [None, "", " ", "\n\n  x", "don't we'll", "a" * 5000, "=" * 3001, "ab" * 2500 + "c", "日本" * 300, "x" * 257, "x" * 256, "word " * 40_000 + "end"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 80))) for _ in range(300)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(200, 400))) for _ in range(20)]
    got = round_trip(spark, texts)
    for k, text in enumerate(texts):
        want = library.encode_ordinary(text or "")
        assert got[k] == (want, library.decode_bytes(want)), repr(text and text[:60])


def test_small_blocks(spark, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "STEP_IDS", 10)
    texts = ["one two three", "", "two two", None, "four " * 30]
    got = round_trip(spark, texts)
    assert [got[k][0] for k in range(5)] == [library.encode_ordinary(t or "") for t in texts]


def test_words_that_are_no_merges(spark, tmp_path):
    # "abc" is a piece that merges don't reach, "bc" goes before "ab"
    ranks = [bytes([b]) for b in range(256)] + [b"bc", b"ab", b"abc", b"abab", b"ca", b"aa", b"aaa"]
    file = tmp_path / "own.tiktoken"
    file.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % k for k, p in enumerate(ranks)))
    own = tiktoken.Encoding("two", pat_str=PATTERN, mergeable_ranks={p: k for k, p in enumerate(ranks)}, special_tokens={})
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(40))) for _ in range(200)] + ["a" * 300, "ab" * 400, "aab" * 200]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in byte_bpe.encode_texts(table, str(file), PATTERN).collect():
        assert r["ids"] == own.encode_ordinary(texts[r["id"]])


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert byte_bpe.decode_ids(byte_bpe.encode_texts(none, PATH, PATTERN), PATH).count() == 0
    rows = spark.createDataFrame([(1, "same"), (1, "same"), (None, "x")], "doc_id long, text string")
    got = [(r["id"], r["ids"]) for r in byte_bpe.encode_texts(rows, PATH, PATTERN).collect()]
    assert len(got) == 3 and len({str(g) for g in got}) == 2


def test_unknown_ids_fail(spark):
    with pytest.raises(Exception, match="lacks an id"):
        byte_bpe.decode_ids(spark.createDataFrame([(1, [70_000])], "id long, ids array<int>"), PATH).collect()
    got = byte_bpe.decode_ids(spark.createDataFrame([(1, None), (2, [])], "id long, ids array<int>"), PATH).collect()
    assert [bytes(r["bytes"]) for r in got] == [b"", b""]


def test_planes():
    numbers = np.array([0, 5, 70_000, 2**31 - 1], np.int32)
    assert byte_bpe.unpacked(byte_bpe.packed(numbers), 4).tolist() == numbers.tolist() and len(byte_bpe.unpacked(byte_bpe.packed(numbers[:0]), 0)) == 0


def test_common_pattern_is_split_alike():
    assert byte_bpe.COMMON_PATTERN == PATTERN
    find = regex.compile(PATTERN).findall
    rng = random.Random(9)
    signs = ["'", "s", "t", "re", "ve", "ll", "d", "m", "r", "v", "l", "e", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "a", "É", "日", "1", "²", "Ⅷ", "!", "😀", "\u0301", "S", "-"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(12))) for _ in range(20_000)]
    words, counts = byte_bpe.split_common(pa.array(texts))
    assert counts.tolist() == [len(find(t)) for t in texts]
    assert words.to_pylist() == [w.encode() for t in texts for w in find(t)]
    words, counts = byte_bpe.split_common(pa.array(["", "x"]).slice(0, 1))
    assert words.to_pylist() == [] and counts.tolist() == [0]


def test_other_patterns(spark, library):
    table = spark.createDataFrame([(1, "ab cd, e"), (2, None)], "doc_id long, text string")
    got = {r["id"]: r["ids"] for r in byte_bpe.encode_texts(table, PATH, r"\w").collect()}
    assert got == {1: [i for c in "abcde" for i in library.encode_ordinary(c)], 2: []}
