"""Tables about a corpus of files: listings, manifests, ratios and what a validator found."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions import cells
from peakloom.operators import folds, lookup

SPACE = re.compile(r"[ \t\r\n\ufeff]*")
LISTING = "Contents array<struct<Key:string,Size:long>>"
#: Endings of files at the root that a site generates, and names that are never data.
SITE_ENDINGS, SITE_NAMES = (".html", ".png", ".tsv", ".sh"), ("README.md",)
FINDINGS = "verdict string, findings array<struct<ruleId:string,level:string,message:string>>"


def read_listing(spark: SparkSession, path: str, hidden: tuple[str, ...] = (), skipped: tuple[str, ...] = SITE_NAMES) -> DataFrame:
    """(subset, dataset, rel, key, size) of the objects that JSON listings of an object store have.

    A file has a document a line, or documents or arrays of them over several lines, any number; one that has neither fails.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.input_file_name().alias("file"))
    rows = lines.select("file", F.ltrim("value").startswith("[").alias("array"), F.from_json("value", f"{LISTING}, _corrupt_record string").alias("r"))
    long = [r["file"] for r in rows.filter(F.col("r._corrupt_record").isNotNull() | F.col("array")).select("file").distinct().collect()]
    contents = rows.filter(~F.col("file").isin(*long)) if long else rows
    contents = contents.select("r.Contents")
    if long:
        whole = spark.read.text([unquote(f) for f in long], wholetext=True).mapInArrow(documents, "value string")
        contents = contents.unionByName(whole.select(F.from_json("value", LISTING, {"mode": "FAILFAST"}).alias("r")).select("r.Contents"))
    objects = contents.select(F.explode("Contents").alias("o")).select(F.col("o.Key").alias("key"), F.col("o.Size").alias("size"))
    return listed_files(objects, hidden, skipped)


def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The JSON documents that follow one another in texts, one a row; those of an array on their own."""
    decoder = json.JSONDecoder()
    for b in batches:
        for text in b.column(0).to_pylist():
            found, begin = [], SPACE.match(text, 0).end()
            while begin < len(text):
                value, end = decoder.raw_decode(text, begin)
                found += [json.dumps(v) for v in value] if isinstance(value, list) else [text[begin:end]]
                begin = SPACE.match(text, end).end()
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["value"])


def listed_files(objects: DataFrame, hidden: tuple[str, ...] = (), skipped: tuple[str, ...] = SITE_NAMES) -> DataFrame:
    """The same from (key, size): a key's first step is its subset, its first two its dataset.

    Left out are what a site generates at the root, names that are never data (there or as a dataset), and hidden subsets.
    """
    key, parts = F.col("key"), F.split("key", "/")
    deep = F.size(parts) > 1
    site = ~deep & (F.coalesce(*[F.when(key.endswith(e), True) for e in SITE_ENDINGS], F.lit(False)))
    name = F.when(deep, F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    keep = ~key.isin(*SITE_NAMES) & ~site & ~name.isin(*skipped)
    if hidden:
        keep &= ~F.get(parts, F.lit(0)).isin(*hidden)
    dataset = F.when(deep, F.concat_ws("/", F.slice(parts, 1, 2))).otherwise("(root)")
    rel = F.when(deep, F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "/")).otherwise(key)
    return objects.filter(keep).select(F.get(parts, F.lit(0)).alias("subset"), dataset.alias("dataset"), rel.alias("rel"), "key", "size")


def described(subsets: DataFrame, known: DataFrame, subset: str = "subset") -> DataFrame:
    """(subset, slug, title, imaging): known subsets as (subset, slug, title, imaging) has them, with defaults for what is null or unknown."""
    rows = subsets.select(subset).distinct().join(F.broadcast(known.withColumnRenamed("subset", "__s")), F.col(subset) == F.col("__s"), "left")
    made = F.regexp_replace(F.col(subset), "[/.]", "-")
    return rows.select(subset, F.coalesce("slug", F.when(made != "", made).otherwise("root")).alias("slug"), F.coalesce("title", subset).alias("title"), F.coalesce("imaging", F.lit(False)).alias("imaging"))


def ratios(files: DataFrame, known: DataFrame) -> DataFrame:
    """(category_slug, category_title, dataset, raw_b, xml_b, archive_b, input_b) of every dataset of listed files."""
    info = described(files, known)
    tiers = folds.corpus_tiers(files.join(F.broadcast(info), "subset").withColumn("__d", F.struct("slug", "title", "dataset")), "__d", "rel", "size", "imaging")
    name = F.regexp_replace("__d.dataset", "^[^/]*/", "")
    return tiers.select(F.col("__d.slug").alias("category_slug"), F.col("__d.title").alias("category_title"), name.alias("dataset"), F.col("raw_bytes").alias("raw_b"), F.col("xml_bytes").alias("xml_b"), F.col("archive_bytes").alias("archive_b"), F.col("input_bytes").alias("input_b"))


def manifest(files: DataFrame, keys: DataFrame, recover: DataFrame, stored: str, unknown: str = "no recorded source") -> DataFrame:
    """(path, bytes, stored, recover_via) of local files (path, key, bytes): whether the store has the key, else where its top folder is recovered from.

    recover has (top, source); keys has (key).
    """
    flagged = lookup.membership(files, keys, "key")
    tops = recover.select(F.col("top").alias("__top"), "source")
    both = flagged.join(F.broadcast(tops), F.substring_index("key", "/", 1) == F.col("__top"), "left")
    via = F.when(F.col("member") == "Y", F.lit(stored)).otherwise(F.coalesce("source", F.lit(unknown)))
    return both.select("path", "bytes", F.col("member").alias("stored"), via.alias("recover_via"))


def manifest_totals(rows: DataFrame) -> DataFrame:
    """One row (files, bytes, stored_files, stored_bytes)."""
    has = F.col("stored") == "Y"
    return rows.agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.count_if(has).alias("stored_files"), F.coalesce(F.sum(F.when(has, F.col("bytes"))), F.lit(0)).alias("stored_bytes"))


def write_tsv(rows: DataFrame, path: str, order: list[str]) -> None:
    """Tab-separated files with a header, in order."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.csv(path, sep="\t", header=True, quote="", emptyValue="")


def findings(reports: DataFrame) -> DataFrame:
    """(file, verdict, errors, warnings): rules and messages by level, from (file, report): a validator's JSON. An unreadable report is an engine error."""
    r = F.from_json("report", FINDINGS)
    rows = reports.select("file", r.alias("r")).withColumn("all", F.coalesce("r.findings", F.array().cast("array<struct<ruleId:string,level:string,message:string>>")))
    ok = F.col("r.verdict").isNotNull()

    def of(*levels: str):
        return F.transform(F.filter("all", lambda f: F.lower(f["level"]).isin(*levels)), lambda f: F.struct(f["ruleId"].alias("rule"), f["message"].alias("message")))

    broken = F.array(F.struct(F.lit("<no-json>").alias("rule"), F.lit("unreadable report").alias("message")))
    return rows.select("file", F.when(ok, F.upper("r.verdict")).otherwise("ENGINE_ERROR").alias("verdict"), F.when(ok, of("error", "fail")).otherwise(broken).alias("errors"), of("warn", "warning").alias("warnings"))


def causes(found: DataFrame, known: DataFrame, level: str = "errors") -> DataFrame:
    """(rule, n, cause, remedy): how many files have a finding of each rule, with what is known of it from (rule, cause, remedy)."""
    rules = found.select("file", F.explode(F.array_distinct(f"{level}.rule")).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    return lookup.known_causes(rules, known, "rule")


def tag_files(files: DataFrame, name: str = "rel") -> DataFrame:
    return files.withColumn("tag", cells.file_tag(F.col(name)))
