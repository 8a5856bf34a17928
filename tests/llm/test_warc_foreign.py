"""Archives as other tools lay them out, and links and files of our own."""

import gzip

import pytest

from peakloom.llm import warc


def record(kind, key, body, *headers):
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{key}>", *headers, f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_either_side_names_the_other(spark, tmp_path):
    http = "Content-Type: application/http;msgtype=response"
    records = [
        record("warcinfo", "w", b"software: x\r\n"),
        record("request", "q1", b"GET / HTTP/1.1\r\n\r\n"),
        record("response", "r1", b"HTTP/1.1 200 OK\r\n\r\none", http, "WARC-Concurrent-To: <q1>", "WARC-Concurrent-To: <m1>"),
        record("metadata", "m1", b"a: 1\r\n"),
        record("revisit", "r2", b"HTTP/1.1 200 OK\r\n\r\n", http, "WARC-Refers-To: <r1>"),
        record("request", "q2", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To:", "\t<r2>"),
        record("resource", "s", b"plain", "WARC-Concurrent-To: <m3>"),
        record("metadata", "m3", b"b: 2\r\n"),
        record("request", "q9", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <absent>"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records[:5])))
    (tmp_path / "b.warc").write_bytes(b"".join(records[5:]))
    got = {r["record_id"]: r for r in warc.assemble(warc.read_archive(spark, str(tmp_path))).collect()}
    assert got.keys() == {"<r1>", "<r2>", "<s>"}
    assert got["<r1>"]["request"]["record_id"] == "<q1>" and got["<r1>"]["metadata"]["fields"] == {"a": "1"} and bytes(got["<r1>"]["response"]["payload"]) == b"one"
    assert got["<r2>"]["request"]["record_id"] == "<q2>" and got["<r2>"]["response"]["refers_to"] == "<r1>" and got["<r2>"]["metadata"] is None
    assert bytes(got["<s>"]["response"]["payload"]) == b"plain" and got["<s>"]["metadata"]["fields"] == {"b": "2"} and got["<s>"]["request"] is None


def test_metadata_joins_through_a_request(spark, tmp_path):
    http = "Content-Type: application/http;msgtype=response"
    records = [
        record("response", "r1", b"HTTP/1.1 200 OK\r\n\r\none", http, "WARC-Concurrent-To: <q1>"),
        record("request", "q1", b"GET / HTTP/1.1\r\n\r\n"),
        record("metadata", "m1", b"a: 1\r\n", "WARC-Concurrent-To: <q1>"),
        record("response", "r2", b"HTTP/1.1 200 OK\r\n\r\ntwo", http),
        record("request", "q2", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <r2>", "WARC-Concurrent-To: <m2>"),
        record("metadata", "m2", b"b: 2\r\n"),
        record("response", "r3", b"HTTP/1.1 200 OK\r\n\r\nthree", http),
        record("request", "q3", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <r3>"),
        record("request", "q0", b"GET / HTTP/1.1\r\n\r\n", "WARC-Concurrent-To: <q3>"),
        record("metadata", "m9", b"c: 3\r\n", "WARC-Concurrent-To: <q9>"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    got = {r["record_id"]: r for r in warc.assemble(warc.read_archive(spark, str(tmp_path))).collect()}
    assert got.keys() == {"<r1>", "<r2>", "<r3>"}
    assert [got[f"<r{k}>"]["request"]["record_id"] for k in (1, 2, 3)] == ["<q1>", "<q2>", "<q3>"]
    assert [m and m["record_id"] for m in (got[f"<r{k}>"]["metadata"] for k in (1, 2, 3))] == ["<m1>", "<m2>", None]


def test_own_revisits_refer_to_a_record(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1000)
    pages = spark.createDataFrame([(k, f"http://{k}", "x" * 600 if k < 3 else str(k) * 600) for k in range(8)], "page_id long, url string, html string").coalesce(1)
    got = {r["metadata"]["fields"]["capture-id"]: r for r in warc.archive_pages(pages, str(tmp_path / "w")).collect()}
    assert len(got) == 8 and all(got[k]["response"]["refers_to"] == got["0"]["record_id"] for k in "12") and got["3"]["response"]["refers_to"] is None
    assert len(list((tmp_path / "w").glob("*/*.gz"))) >= 5


def test_cut_archives_fail():
    whole = record("resource", "s", b"plain")
    assert next(warc.parse(whole, True))["payload"] == b"plain"
    with pytest.raises(ValueError):
        list(warc.parse(whole[:-6], True))
    with pytest.raises(ValueError, match="no length"):
        list(warc.parse(whole.replace(b"Content-Length: 5", b"Content-Type: text/plain"), True))


def test_long_pages(spark, tmp_path):
    """Payloads of several MB, between short ones, come back whole."""
    pages = spark.createDataFrame([(k, f"http://{k}", f"<{k}>" + "é\r\n" * (700_000 if k % 3 == 0 else 2)) for k in range(7)], "page_id long, url string, html string")
    got = {r["metadata"]["fields"]["capture-id"]: r["response"] for r in warc.archive_pages(pages, str(tmp_path / "w")).collect()}
    want = {str(r["page_id"]): r["html"].encode() for r in pages.collect()}
    assert {k: bytes(r["payload"]) for k, r in got.items()} == want and all(r["computed_digest"] == r["payload_digest"] for r in got.values())
