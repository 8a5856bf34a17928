"""WARC archives: writing captures and assembling transactions again.

A capture is three records that name each other: a response (or a revisit of an earlier response with the same
payload), the request and a metadata record, both concurrent to it. Spark's text writer lays the records down, one
gzip stream a file; reading parses files record by record and joins the records of each capture, whichever names the other.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from base64 import b32encode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import join_groups
from peakloom.session import materialize

#: Bytes after which a task begins another file: a file is parsed by one task. A capture's headers count as HEADER_BYTES.
FILE_BYTES, HEADER_BYTES = 32 << 20, 1024
#: Types of the records that are captures.
MAIN = ("response", "revisit", "resource")
CRLF = "\r\n"
RECORD = "record_id string, record_type string, uri string, date string, concurrent_to array<string>, refers_to string, payload_digest string, computed_digest string, payload_bytes long, fields map<string,string>, payload binary"


def base32_sha1(col: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 40 bits of the digest are eight base-32 digits."""
    digest = F.sha1(col)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def urn(*cols: Column) -> Column:
    """A stable record id from the columns, as a UUID URN."""
    h = F.md5(F.concat_ws("\x1f", *cols).cast("binary"))
    groups = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def record(kind: Column, headers: list[tuple[str, Column]], body: Column) -> Column:
    """One record as text; a header whose value is null is left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), body)


def plan_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(id, uri, payload, digest, n_bytes, first_id, first_uri): the last two are those of the response that a revisit refers to, else null.

    Of pages with equal payloads of at least least_bytes the one with the smallest id is the response. Only ids and
    digests are grouped; texts of frequent payloads aren't shuffled at all.
    """
    rows = pages.select(
        F.col(id_col).alias("id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\s\p{Cntrl}]", "%20").alias("uri"),
        F.coalesce(F.col(html_col), F.lit("")).alias("payload"),
    ).withColumns({"digest": base32_sha1(F.col("payload").cast("binary")), "n_bytes": F.octet_length("payload").cast("long")})
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "uri")))
    groups = rows.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("copies"))
    found = join_groups(rows, groups, "digest", "copies")
    revisit = (F.col("n_bytes") >= least_bytes) & (F.col("copies") > 1) & (F.col("id") > F.col("first.id"))
    return found.withColumns({"first_id": F.when(revisit, F.col("first.id")), "first_uri": F.when(revisit, F.col("first.uri"))}).drop("copies", "first")


def numbered_files(captures: DataFrame) -> DataFrame:
    """captures with `file`, which in each task counts up whenever the captures since its start pass another FILE_BYTES."""
    names, limit = [*captures.columns, "file"], FILE_BYTES
    at = names.index("n_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            ends = before + np.cumsum(batch.column(at).to_numpy() + HEADER_BYTES)
            before = int(ends[-1]) if len(ends) else before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends // limit, pa.int32())], names=names)

    return captures.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in [*captures.dtypes, ("file", "int")]))


def write_archive(captures: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write planned captures as gzipped WARC files under path, in folders by each task's file number."""
    captures = numbered_files(captures)
    key, uri = F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("uri")
    revisit = F.col("first_id").isNotNull()
    main = urn(F.lit("response"), key, uri, F.col("digest"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(CRLF + CRLF))
    when = ("WARC-Date", F.lit(date))
    response = record(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        [
            ("WARC-Record-ID", main), when, ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Refers-To", F.when(revisit, urn(F.lit("response"), F.col("first_id").cast("string"), F.col("first_uri"), F.col("digest")))),
            ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
    )
    path_part = F.regexp_replace(uri, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    request = record(
        F.lit("request"),
        [("WARC-Record-ID", urn(F.lit("request"), main)), when, ("WARC-Target-URI", uri), ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/http;msgtype=request"))],
        F.concat(F.lit("GET "), F.when(path_part == "", F.lit("/")).otherwise(path_part), F.lit(f" HTTP/1.1{CRLF}Accept: text/html{CRLF}{CRLF}")),
    )
    fields = F.concat_ws(
        CRLF,
        F.concat(F.lit("capture-id: "), F.col("id").cast("string")),
        F.concat(F.lit("payload-bytes: "), F.col("n_bytes").cast("string")),
        F.concat(F.lit("refers-to-capture: "), F.col("first_id").cast("string")),
    )
    metadata = record(
        F.lit("metadata"),
        [("WARC-Record-ID", urn(F.lit("metadata"), main)), when, ("WARC-Target-URI", uri), ("WARC-Concurrent-To", main), ("Content-Type", F.lit("application/warc-fields"))],
        fields,
    )
    rows = captures.select("file", F.explode(F.array(request, response, metadata)).alias("value"))
    rows.write.partitionBy("file").option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def parse(data: bytes, payloads: bool) -> Iterator[dict]:
    """The records of one archive file, gzipped (in one member or many) or not; no more than a record is unpacked at a time.

    A record without a proper length, or one within which the file ends, is an error: what follows it can't be told apart.
    """
    raw = io.BytesIO(data)
    source = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) if data[:2] == b"\x1f\x8b" else raw
    while line := source.readline():
        if not line.startswith(b"WARC/"):
            continue
        lines: list[list[str]] = []
        while (line := source.readline()).strip():
            text = line.decode("utf-8", "replace")
            if lines and text[0] in " \t":  # a folded header goes on
                lines[-1][1] = f"{lines[-1][1]} {text.strip()}".strip()
            else:
                name, _, value = text.partition(":")
                lines.append([name.strip().lower(), value.strip()])
        head = dict(lines)
        if not head.get("content-length", "").isdecimal():
            raise ValueError(f"record {head.get('warc-record-id')} has no length")
        body = source.read(int(head["content-length"]))
        if len(body) != int(head["content-length"]):
            raise ValueError(f"the archive ends within record {head.get('warc-record-id')}")
        kind, fields, payload = head.get("warc-type"), None, None
        if kind == "response":
            payload = body.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else body
        elif kind == "resource":
            payload = body
        elif kind == "metadata":
            pairs = (line.partition(":") for line in body.decode("utf-8", "replace").split("\r\n") if ":" in line)
            fields = [(k.strip(), v.strip()) for k, _, v in pairs]
        yield {
            "record_id": head.get("warc-record-id"), "record_type": kind, "uri": head.get("warc-target-uri"), "date": head.get("warc-date"),
            "concurrent_to": [v for n, v in lines if n == "warc-concurrent-to"], "refers_to": head.get("warc-refers-to"),
            "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
            "computed_digest": b32encode(hashlib.sha1(payload).digest()).decode() if payload is not None else None,
            "payload_bytes": len(payload) if payload is not None else None, "fields": fields, "payload": payload if payloads else None,
        }


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives under path; payloads are left out if not asked for. A broken archive fails."""
    text = pa.string()
    schema = pa.schema([(n, pa.list_(text) if n == "concurrent_to" else text) for n in ("record_id", "record_type", "uri", "date", "concurrent_to", "refers_to", "payload_digest", "computed_digest")] + [("payload_bytes", pa.int64()), ("fields", pa.map_(text, text)), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                some = []
                for x in parse(data.as_py(), payloads):
                    some.append(x)
                    if len(some) == 500:
                        yield pa.RecordBatch.from_pylist(some, schema)
                        some = []
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: (record_id, response, request, metadata).

    Captures are responses, revisits and resources. Requests and metadata join the capture that they are concurrent
    to, or that says it is concurrent to them; a metadata record also joins the captures of the requests that it names
    or that name it. Records that repeat an id are one; of several requests (or metadata
    records) of a capture the one with the smallest id stands; a missing one is null. Requests of no capture are dropped.
    """
    is_main, is_side = F.col("record_type").isin(*MAIN), F.col("record_type").isin("request", "metadata")
    response = F.struct("record_type", "uri", "date", "refers_to", "payload_digest", "computed_digest", "payload_bytes", "payload")
    nested = F.struct("record_id", "uri", "date", "fields")

    def beside(kind: str) -> Column:
        own = F.col("record_type") == kind
        return F.min_by(F.when(own, F.col("nested")), F.when(own, F.col("nested.record_id"))).alias(kind)

    # each capture under its own id, requests and metadata under the ids that they name
    keys = F.when(is_main, F.array("record_id")).when(is_side, F.col("concurrent_to"))
    rows = records.filter(is_main | is_side).select(F.explode(keys).alias("record_id"), "record_type", F.when(is_main, response).alias("response"), F.when(is_side, nested).alias("nested"))
    found = rows.groupBy("record_id").agg(F.first("response", ignorenulls=True).alias("response"), beside("request"), beside("metadata")).filter(F.col("response").isNotNull())
    # requests and metadata that a capture names
    named = records.filter(is_main).select(F.col("record_id").alias("main"), F.explode("concurrent_to").alias("side")).distinct()
    # metadata that a request of a capture names, or that names it
    links = records.filter(is_side).select(F.col("record_id").alias("side"), F.col("record_type").alias("kind"), F.explode("concurrent_to").alias("target")).distinct()
    by_request = links.filter("kind = 'request'").select(F.col("side").alias("request"), "target")
    about = by_request.select("request", F.col("target").alias("side")).union(links.filter("kind = 'metadata'").select(F.col("target").alias("request"), "side"))
    captures = by_request.select("request", F.col("target").alias("main")).union(named.select(F.col("side").alias("request"), "main"))
    beyond = about.join(captures, "request").filter("main <> side").select("main", "side", F.lit(True).alias("by_request"))
    sides = records.filter(is_side).select(F.col("record_id").alias("side"), "record_type", nested.alias("nested"))
    linked = named.withColumn("by_request", F.lit(False)).union(beyond).join(sides, "side").filter("not by_request or record_type = 'metadata'")
    other = linked.groupBy(F.col("main").alias("record_id")).agg(beside("request").alias("request_named"), beside("metadata").alias("metadata_named"))

    def least(kind: str) -> Column:
        a, b = F.col(kind), F.col(f"{kind}_named")
        return F.when(a.isNull() | (b["record_id"] < a["record_id"]), b).otherwise(a).alias(kind)

    return found.join(other, "record_id", "left").select("record_id", "response", least("request"), least("metadata"))


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, payloads: bool = True) -> DataFrame:
    """Write pages as an archive at path and read it back as nested captures.

    A null html is an empty payload, a null url an empty one (white space in it becomes %20), a null id has no
    capture-id field. Rows that repeat id, url and payload are one capture. An empty table gives no rows; columns
    other than the three named are ignored.
    """
    write_archive(plan_captures(pages, id_col, url_col, html_col, least_bytes), path)
    records = read_archive(pages.sparkSession, path, payloads)
    # each file is parsed once: records are joined from several sides
    return assemble(materialize(records, "warc-records"))
