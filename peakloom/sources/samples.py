"""Sample metadata: tab-separated sample tables (SDRF), ISA-Tab files and ISA-JSON documents."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions.cells import REAGENTS, UNRESOLVED, UNRESOLVED_TERM, cell, curie
from peakloom.operators import folds, lookup
from peakloom.session import materialize
from peakloom.sources import xml


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """(row_idx, pos, header, raw) of every cell of a tab-separated file.

    Quotes mean nothing, rows may be ragged, headers may repeat: hence lines, not the CSV source. A missing cell is
    empty; cells beyond the header are dropped; an empty file gives no rows.
    """
    lines = F.filter(F.split("value", "\r?\n"), lambda v: F.trim(v) != "")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("line", "value")).withColumn("row_idx", F.col("line") - 1)
    head = rows.filter("row_idx = -1").select(F.split("value", "\t", -1).alias("names"))
    both = rows.filter("row_idx >= 0").join(F.broadcast(head)).select("row_idx", "names", F.split("value", "\t", -1).alias("cells"))
    spread = both.select("row_idx", "cells", F.posexplode("names").alias("pos", "header"))
    return spread.select(F.col("row_idx").cast("long").alias("row_idx"), "pos", F.trim("header").alias("header"), F.coalesce(F.get("cells", "pos"), F.lit("")).alias("raw"))


def column(cells: DataFrame, header: str) -> DataFrame:
    """(row_idx, value) of the first column with the header, without case."""
    named = cells.filter(F.lower("header") == header.lower())
    return named.groupBy("row_idx").agg(F.min_by(F.trim("raw"), "pos").alias("value"))


def samples(cells: DataFrame) -> DataFrame:
    """(sample_id, name, characteristics): one sample per distinct source name, described by its first row."""
    named = folds.sample_table(column(cells, "source name").withColumnRenamed("value", "n").filter("n <> ''"), "n", "row_idx")
    traits = cells.filter(F.lower("header").startswith("characteristics[")).select("row_idx", "pos", F.regexp_extract("header", r"\[(.*)\]", 1).alias("category"), cell(F.col("raw")).alias("cell"))
    both = named.join(traits, named["first_row"] == traits["row_idx"], "left")
    nested = F.array_sort(F.collect_list(F.when(F.col("category").isNotNull(), F.struct("pos", "category", "cell"))))
    return both.groupBy("sample_id", "name").agg(nested.alias("characteristics"))


def assays(cells: DataFrame) -> DataFrame:
    """(row_idx, assay_id, sample, data_file, label): one assay per row, named or numbered."""
    names = {"assay": "assay name", "sample": "source name", "data_file": "comment[data file]", "label": "comment[label]"}
    out = cells.select("row_idx").distinct()
    for name, header in names.items():
        out = out.join(column(cells, header).withColumnRenamed("value", name), "row_idx", "left")
    numbered = F.concat(F.lit("assay-"), (F.col("row_idx") + 1).cast("string"))
    return out.select("row_idx", F.coalesce(F.nullif("assay", F.lit("")), numbered).alias("assay_id"), "sample", "data_file", "label")


def factors(cells: DataFrame) -> DataFrame:
    """(factor, sample, value, first_row): distinct non-empty factor values by sample."""
    values = cells.filter(F.lower("header").startswith("factor value[")).select("row_idx", F.regexp_extract("header", r"\[(.*)\]", 1).alias("factor"), F.trim("raw").alias("value")).filter("value <> ''")
    named = column(cells, "source name").withColumnRenamed("value", "sample")
    return values.join(named, "row_idx").groupBy("factor", "sample", "value").agg(F.min("row_idx").alias("first_row"))


def match_rows(runs: DataFrame, cells: DataFrame, run: str = "path") -> DataFrame:
    """(run, row_idx) of the table's rows whose data file has the run's stem."""
    keyed = assays(cells).select(lookup.stem(F.col("data_file")).alias("__stem"), "row_idx")
    return runs.select(run).withColumn("__stem", lookup.stem(F.col(run))).join(keyed, "__stem").select(run, "row_idx")


def bind_runs(runs: DataFrame, cells: DataFrame, run: str = "path") -> DataFrame:
    """(run, sample_ids, diagnostic): the ordered distinct samples of the rows whose data file has the run's stem.

    No row or several rows are diagnostics, never errors.
    """
    named = assays(cells).join(samples(cells).select("sample_id", F.col("name").alias("sample")), "sample", "left").select("row_idx", "sample_id")
    both = runs.select(run).join(match_rows(runs, cells, run), run, "left").join(named, "row_idx", "left")
    both = both.groupBy(run).agg(F.count("row_idx").alias("n"), F.array_sort(F.collect_list(F.when(F.col("sample_id").isNotNull(), F.struct("row_idx", "sample_id")))).alias("s"))
    diagnostic = F.when(F.col("n") == 0, "no row").when(F.col("n") > 1, "several rows")
    return both.select(run, F.array_distinct("s.sample_id").alias("sample_ids"), diagnostic.alias("diagnostic"))


def channels(spark: SparkSession, labels: DataFrame, label: str = "label") -> DataFrame:
    """labels with channel, accession and target: the reagent of each trimmed label.

    A label that is isobaric but has no reporter ion of its own has the parent term and a null target; others have nulls.
    """
    known = [*REAGENTS, *((name, UNRESOLVED_TERM, None) for name in UNRESOLVED)]
    table = spark.createDataFrame(known, "channel string, accession string, target double")
    return labels.join(F.broadcast(table), F.trim(F.col(label)) == table["channel"], "left")


def isa_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(section, line, key, values) of an ISA-Tab investigation file: a line of capitals alone opens a section."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value")).filter(F.trim("value") != "")
    parts = F.transform(F.split("value", "\t", -1), lambda v: F.regexp_replace(F.trim(v), '^"|"$', ""))
    rows = lines.select("line", parts.alias("p"))
    opens = F.get("p", F.lit(0)).rlike("^[A-Z][A-Z ]+$") & ~F.exists(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda v: v != "")
    filled = lookup.fill_down(rows, [], "line", F.when(opens, F.get("p", F.lit(0))), "section")
    return filled.filter(~opens).select("section", "line", F.get("p", F.lit(0)).alias("key"), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))).alias("values"))


def isa_value(blocks: DataFrame, section: str, key: str) -> DataFrame:
    """One row with the first non-blank value of a key of a section."""
    found = blocks.filter((F.col("section") == section) & (F.col("key") == key)).select("line", F.get(F.filter("values", lambda v: v != ""), F.lit(0)).alias("v"))
    return found.filter("v is not null").agg(F.min_by("v", "line").alias("value"))


def isa_values(blocks: DataFrame, section: str, key: str) -> DataFrame:
    """(place, value) of all non-blank values of the first line with a key in a section."""
    line = blocks.filter((F.col("section") == section) & (F.col("key") == key)).orderBy("line").limit(1)
    return line.select(F.posexplode("values").alias("place", "value")).select("place", F.trim("value").alias("value")).filter("value <> ''")


def isa_identity(blocks: DataFrame) -> DataFrame:
    """One row (accession, title): the study's, else the investigation's, else empty."""
    def first(name: str) -> Column:
        def own(section: str, key: str) -> Column:
            hit = (F.col("section") == section) & (F.col("key") == key)
            return F.nullif(F.trim(F.min_by(F.when(hit, F.get("values", F.lit(0))), F.when(hit, F.col("line")))), F.lit(""))

        return F.coalesce(own("STUDY", f"Study {name}"), own("INVESTIGATION", f"Investigation {name}"), F.lit(""))

    return blocks.agg(first("Identifier").alias("accession"), first("Title").alias("title"))


def isa_ontologies(blocks: DataFrame) -> DataFrame:
    """(name) of the ontologies that an investigation declares."""
    return isa_values(blocks, "ONTOLOGY SOURCE REFERENCE", "Term Source Name").select(F.col("value").alias("name")).distinct()


def isa_traits(study: DataFrame) -> DataFrame:
    """(row_idx, pos, category, value struct<value, accession, term_source, extra>) of an ISA-Tab table's characteristics and factors.

    A value column takes the term columns right after it; what isn't a CURIE stays in extra.
    """
    cells = unquoted(study)
    header = cells.select("pos", "header").distinct().agg(F.array_sort(F.collect_list(F.struct("pos", "header"))).alias("h")).select(F.explode(paired_columns(F.col("h.header"))).alias("c")).select("c.*")
    wanted = header.filter(F.col("name").rlike(r"(?i)^(characteristics|factor value|parameter value)\["))
    named = wanted.select("pos", "ref_pos", "accession_pos", F.regexp_extract("name", r"\[(.*)\]", 1).alias("category"))
    at = lambda c, n: cells.select("row_idx", F.col("pos").alias(c), F.col("raw").alias(n))
    rows = named.join(at("pos", "__v"), "pos").join(at("ref_pos", "__s"), ["row_idx", "ref_pos"], "left").join(at("accession_pos", "__a"), ["row_idx", "accession_pos"], "left")
    return rows.select("row_idx", "pos", "category", isa_value_of(F.col("__v"), F.col("__s"), F.col("__a")).alias("value"))


def paired_columns(header: Column) -> Column:
    """Array of (pos, name, ref_pos, accession_pos): ISA-Tab value columns with the term columns that follow them."""
    named = F.transform(header, lambda h, i: F.struct(i.alias("pos"), h.alias("name")))
    follows = lambda i, k, t: F.get(header, i + k) == t
    with_terms = F.transform(named, lambda c: F.struct(
        c["pos"].alias("pos"), c["name"].alias("name"), F.when(follows(c["pos"], 1, "Term Source REF"), c["pos"] + 1).alias("ref_pos"),
        F.when(follows(c["pos"], 1, "Term Source REF") & follows(c["pos"], 2, "Term Accession Number"), c["pos"] + 2).alias("accession_pos"),
    ))
    return F.filter(with_terms, lambda c: ~c["name"].isin("Term Source REF", "Term Accession Number"))


def isa_value_of(value: Column, source: Column, accession: Column) -> Column:
    """Struct (value, accession, term_source, extra): an accession that is a URL or no CURIE stays in extra."""
    given = F.nullif(F.trim(accession), F.lit(""))
    ok = ~F.contains(given, F.lit("://")) & curie(given).isNotNull()
    return F.struct(F.trim(value).alias("value"), F.when(ok, given).alias("accession"), F.nullif(F.trim(source), F.lit("")).alias("term_source"), F.when(~ok, given).alias("extra"))


def unquoted(cells: DataFrame) -> DataFrame:
    """Cells of an ISA-Tab table without the quotes around headers and values."""
    return cells.withColumns({c: F.regexp_replace(F.trim(c), '^"|"$', "") for c in ("header", "raw")})


def isa_study_samples(study: DataFrame) -> DataFrame:
    """(sample_id, name, source): the samples of an ISA-Tab study table by sample name, with their source names.

    Assays refer to sample names and traits belong to sources, so both are carried.
    """
    cells = unquoted(study)
    rows = column(cells, "sample name").withColumnRenamed("value", "n").filter("n <> ''")
    sources = column(cells, "source name").withColumnRenamed("value", "source").withColumnRenamed("row_idx", "first_row")
    return folds.sample_table(rows, "n", "row_idx").join(sources, "first_row", "left").select("sample_id", "name", "source")


def isa_assays(tables: list[DataFrame]) -> DataFrame:
    """(file_no, row_idx, assay_id, sample, data_files) of ISA-Tab assay tables, one after the other."""
    out = None
    for k, table in enumerate(tables):
        cells = unquoted(table)
        names = cells.select("row_idx").distinct()
        for name, header in (("assay", "ms assay name"), ("sample", "sample name")):
            names = names.join(column(cells, header).withColumnRenamed("value", name), "row_idx", "left")
        files = cells.filter(F.lower("header").endswith("spectral data file") & (F.col("raw") != "")).groupBy("row_idx").agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("f"))
        part = names.join(files, "row_idx", "left").select(
            F.lit(k).alias("file_no"), "row_idx", F.coalesce(F.nullif("assay", F.lit("")), F.concat(F.lit("assay-"), (F.col("row_idx") + 1).cast("string"))).alias("assay_id"),
            "sample", F.coalesce(F.col("f.raw"), F.array().cast("array<string>")).alias("data_files"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def bind_isa_runs(runs: DataFrame, assay_rows: DataFrame, run: str = "path") -> DataFrame:
    """(run, samples, diagnostic): ordered distinct samples of the assays one of whose data files has the run's stem."""
    files = assay_rows.select("file_no", "row_idx", "sample", F.explode(F.array_distinct(F.transform("data_files", lookup.stem))).alias("__stem"))
    both = runs.select(run).withColumn("__stem", lookup.stem(F.col(run))).join(files, "__stem", "left")
    found = both.groupBy(run).agg(F.count("row_idx").alias("n"), F.array_sort(F.collect_list(F.when(F.col("sample").isNotNull(), F.struct("file_no", "row_idx", "sample")))).alias("s"))
    diagnostic = F.when(F.col("n") == 0, "no row").when(F.col("n") > 1, "several rows")
    return found.select(run, F.array_distinct("s.sample").alias("samples"), diagnostic.alias("diagnostic"))


def locate_isa(path: str) -> dict:
    """Files of an ISA bundle: from its folder, its investigation, a sibling of it, or an ISA-JSON document.

    {json} or {investigation, studies, assays}: the files that the investigation names, which must be there; where it
    names none, those with the prefixes, in order of their names.
    """
    import glob
    import os

    if path.endswith(".json"):
        return {"json": path}
    folder = path if os.path.isdir(path) else os.path.dirname(path)
    own = os.path.basename(path)
    if own.startswith("i_") and not os.path.isdir(path):
        investigation = path
    else:
        found = sorted(glob.glob(os.path.join(glob.escape(folder), "i_*.txt")))
        if not found:
            raise FileNotFoundError(f"no investigation file in {folder}")
        investigation = found[0]
    declared: dict[str, list[str]] = {"Study File Name": [], "Study Assay File Name": []}
    with open(investigation, encoding="utf-8", errors="replace") as f:  # a few lines
        for line in f:
            key, *values = (v.strip().strip('"') for v in line.rstrip("\r\n").split("\t"))
            if key in declared and not declared[key]:
                declared[key] = [v for v in values if v]

    def files(names: list[str], letter: str) -> list[str]:
        if not names:
            return sorted(glob.glob(os.path.join(glob.escape(folder), f"{letter}_*.txt")))
        paths = [os.path.join(folder, n) for n in names]
        for p in paths:
            if not os.path.exists(p):
                raise FileNotFoundError(f"{investigation} names {p}, which isn't there")
        return paths

    return {"investigation": investigation, "studies": files(declared["Study File Name"], "s"), "assays": files(declared["Study Assay File Name"], "a")}


REF = "struct<`@id`:string>"
TERM = "annotationValue:string,termSource:string,termAccession:string"
#: A value is an annotation, a text or a number: read as its JSON text.
VALUES = f"array<struct<category:{REF},value:string,unit:{REF}>>"
MATERIAL = f"`@id`:string,name:string,characteristics:{VALUES}"
SAMPLE = f"{MATERIAL},derivesFrom:array<{REF}>,factorValues:{VALUES}"
STEP = f"`@id`:string,inputs:array<{REF}>,outputs:array<{REF}>"
#: A reader goes no deeper than these lists and texts of an ISA-JSON document's first study; assays have lists of their own.
STUDY = ("studies", 0)
LISTS = {(*STUDY, "materials", "samples"), (*STUDY, "materials", "sources"), (*STUDY, "characteristicCategories"), (*STUDY, "factors"), (*STUDY, "unitCategories")}
ASSAY_LISTS = {"dataFiles", "processSequence"}
TEXTS = {("identifier",): "identifier", ("title",): "title", (*STUDY, "identifier"): "study.identifier", (*STUDY, "title"): "study.title"}
#: Characters of a document that are read together; a cut is always after a brace.
CHUNK = 1 << 20
STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*(")?', re.S)
TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*("?)|[{}\[\],:]', re.S)


def walk_json(text: str, inside: bool, stack: list[list] | None) -> tuple[list, list[tuple]]:
    """A chunk of a JSON document whose stack of open containers, each [bracket, place, key], is known or None.

    inside: whether it begins in a string. Returns (what the chunk does to any stack: whether it ends in a string,
    containers that it closes, commas and the last key after that in the container then open, containers that it
    leaves open; wanted values or parts of some: (kind, assay, place, text, whether it is whole)).
    """
    known, found = stack is not None, []
    stack = [list(f) for f in stack] if known else []
    closed, commas, key, at, pending = 0, 0, False, 0, None
    taken = depth = None  # what is being taken, and how many containers are open around it
    began = True  # in this chunk
    if known:
        for k in range(len(stack)):
            if own := wanted(stack[: k + 1]):
                taken, depth, began = own, k + 1, False
                break
    start = 0
    if inside:
        at = STRING_END.match(text)
        inside, at = at[1] is None, at.end()
    for m in TOKEN.finditer(text, at) if not inside else ():
        c = text[m.start()]
        if c == '"':
            inside = not m[1]
            pending = None if inside else m[0][1:-1]
        elif c in "{[":
            stack.append([c, 0, None])
            if known and taken is None and c == "[" and (own := wanted(stack)):
                taken, depth, began, start = own, len(stack), True, m.end()
        elif c == ":":
            if stack:
                stack[-1][2] = pending
                if known and taken is None and (own := wanted(stack)):
                    taken, depth, began, start = own, len(stack), True, m.end()
            else:
                key = pending
        else:
            if taken is not None and len(stack) == depth:
                found.append((*taken, text[start : m.start()], began))
                began, start, listed = True, m.end(), stack[-1][0] == "["
                taken = (*taken[:2], taken[2] + 1) if c == "," and listed else None
            if c == ",":
                if stack:
                    stack[-1][1], stack[-1][2] = stack[-1][1] + 1, None
                else:
                    commas, key = commas + 1, None
            elif stack:
                stack.pop()
            else:
                closed, commas, key = closed + 1, 0, False
    if taken is not None:
        found.append((*taken, text[start:], False))
    return [inside, closed, commas, key, stack], found


def wanted(stack: list[list]) -> tuple[str, int, int] | None:
    """(kind, assay, place) of the value in the innermost container, if it is one of those that are read."""
    bracket, place, key = stack[-1]
    if len(stack) > 6 or stack[0][0] == "[":
        return None
    path = tuple(f[2] if f[0] == "{" else f[1] for f in stack)
    if bracket == "{":
        return (TEXTS[path], 0, 0) if path in TEXTS else None
    if path[:-1] in LISTS:
        return path[-2], 0, place
    if len(path) == 6 and path[:3] == (*STUDY, "assays") and path[4] in ASSAY_LISTS:
        return path[4], path[3], place
    return None


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """(block, no, text, read): a JSON document in chunks that many tasks read, in order of block and number.

    Each ends with a brace, in the last one of a file that doesn't end with one too; `read` counts them all in bytes.
    """
    encoding = json_encoding(spark, path)
    brace = len("}".encode(encoding))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, no, held, size, read = None, 0, [], 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "no": pa.array([no], pa.int64()), "text": ["".join(held)], "read": pa.array([read], pa.int64())})

        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (size >= CHUNK or b != block):
                    yield out()
                    no, held, size, read = no + 1 if b == block else 0, [], 0, 0
                block = b
                held.append(data.decode(encoding, "replace") + "}")
                size, read = size + len(held[-1]), read + len(data) + brace
        if held:
            yield out()

    pieces = spark.read.option("lineSep", "}").option("encoding", encoding).text(path)  # of the separator; texts come as they are
    return pieces.select(F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary")).mapInArrow(joined, "block long, no long, text string, read long")


def json_encoding(spark: SparkSession, path: str) -> str:
    """By its mark or the zeros in its first characters, which are ASCII."""
    head = next(xml.chunks(spark, path, 4), b"")
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16LE" if head[0] == 0xFF else "UTF-16BE"
    return "UTF-16BE" if head[:1] == b"\0" else "UTF-16LE" if head[1:2] == b"\0" else "UTF-8"


def file_bytes(spark: SparkSession, path: str) -> int:
    return spark.read.format("binaryFile").load(path).select("length").first()["length"]


def read_isa_json(spark: SparkSession, path: str) -> DataFrame:
    """(kind, assay, place, text): identifiers, titles and list elements of an ISA-JSON investigation's first study, each as its JSON text.

    The document is cut into chunks that tasks read on their own. What each does to the brackets around it, whether it
    begins in a string or not, goes to the driver, some numbers for each; from that every chunk's place in the document
    is known, and the tasks take the values. A document that doesn't end fails.
    """
    parts = materialize(chunks(spark, path), "json-chunks")

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [json.dumps([walk_json(t, inside, None)[0] for inside in (False, True)]) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told, pa.string()), batch.column(3)], names=["block", "no", "told", "read"])

    inside, stack, begins, read, unopened = False, [], {}, 0, 0
    for k, r in enumerate(sorted(parts.mapInArrow(effects, "block long, no long, told string, read long").collect())):
        begins[r["block"], r["no"]] = (k, inside, [list(f) for f in stack])
        inside, closed, commas, key, opened = json.loads(r["told"])[inside]
        read, unopened = read + r["read"], unopened + max(0, closed - len(stack))
        stack = stack[: max(0, len(stack) - closed)]
        if stack:
            stack[-1][1] += commas
            stack[-1][2] = stack[-1][2] if key is False else key
        stack += opened
    if inside or stack or not begins or unopened != (read > file_bytes(spark, path)):
        raise ValueError(f"MALFORMED: {path} ends within a value")
    shared = spark.sparkContext.broadcast(begins)

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, no, text in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                k, inside, stack = shared.value[block, no]
                rows = [r for r in walk_json(text, inside, stack)[1] if not r[4] or r[3].strip()]
                kind, assay, place, own, whole = zip(*rows, strict=True) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kind, pa.string()), pa.array(assay, pa.int32()), pa.array(place, pa.int32()), pa.array(own, pa.string()), pa.array(whole, pa.bool_()), pa.array([k] * len(rows), pa.int32())],
                    names=["kind", "assay", "place", "text", "whole", "k"],
                )

    found = materialize(parts.mapInArrow(values, "kind string, assay int, place int, text string, whole boolean, k int"), "json-values")
    cut = found.filter("not whole").groupBy("kind", "assay", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda p: p["text"]), "").alias("text"))
    return found.filter("whole").select("kind", "assay", "place", "text").union(cut.filter("trim(text) <> ''"))


def isa_json_list(doc: DataFrame, kind: str, fields: str) -> DataFrame:
    """(assay, place, m): the elements of a list of the document, as structs of the fields."""
    return doc.filter(F.col("kind") == kind).select("assay", "place", F.from_json("text", f"struct<{fields}>").alias("m"))


def isa_json_identity(doc: DataFrame) -> DataFrame:
    """One row (accession, title): the study's, else the investigation's, else empty."""
    text = F.from_json(F.concat(F.lit('{"v":'), "text", F.lit("}")), "v string")["v"]
    own = lambda kind: F.max(F.when(F.col("kind") == kind, text))
    first = lambda name: F.coalesce(own(f"study.{name}"), own(name), F.lit(""))
    return doc.agg(first("identifier").alias("accession"), first("title").alias("title"))


def isa_files(doc: DataFrame) -> DataFrame:
    """(file, sample, diagnostic): data files with the samples that their process takes in.

    An input that is neither a sample nor a source stays as its id, with a diagnostic.
    """
    named = lambda kind: isa_json_list(doc, kind, "`@id`:string,name:string").select(F.col("m.`@id`").alias("key"), F.col("m.name").alias("name"))
    steps = isa_json_list(doc, "processSequence", STEP)
    files = isa_json_list(doc, "dataFiles", "`@id`:string,name:string").join(steps.select("assay").distinct(), "assay", "left_semi").select(F.col("m.`@id`").alias("id"), F.col("m.name").alias("file")).distinct()
    pairs = steps.select(F.explode("m.inputs").alias("i"), F.col("m.outputs").alias("o")).select(F.col("i.`@id`").alias("input"), F.explode("o").alias("o")).select("input", F.col("o.`@id`").alias("id"))
    found = lookup.resolve(pairs.join(files, "id"), "input", [(named("samples"), "key", "name"), (named("sources"), "key", "name")])
    return found.select("file", F.col("resolved").alias("sample"), "diagnostic").distinct()


def isa_json_traits(doc: DataFrame) -> DataFrame:
    """(place, sample, kind, pos, category, value, unit) of an ISA-JSON document's samples: characteristics of the sources that they derive from, then their own, then factor values.

    Categories, factors and units are resolved in the document; one that it doesn't declare has the last part of its id
    as its name. value and unit are typed as in ISA-Tab: an address is no accession and stays in extra. place is the
    sample's, pos the value's among all of its sample.
    """
    listed = lambda kind, schema, *fields: isa_json_list(doc, kind, schema).select("place", *fields)
    key = F.col("m.`@id`").alias("key")
    one = lambda kind, values: F.transform(F.coalesce(values, F.array().cast(VALUES)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("v")))
    samples = listed("samples", SAMPLE, key, F.col("m.name").alias("sample"), one("characteristic", F.col("m.characteristics")).alias("own"), one("factor", F.col("m.factorValues")).alias("factors"), F.col("m.derivesFrom").alias("derives"))
    sources = listed("sources", MATERIAL, key, one("characteristic", F.col("m.characteristics")).alias("given")).select(F.col("key").alias("source"), "given")
    given = samples.select("key", F.posexplode("derives").alias("k", "d")).select("key", "k", F.col("d.`@id`").alias("source")).join(sources, "source")
    given = given.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "given"))), lambda g: g["given"])).alias("given"))
    all_ = samples.join(given, "key", "left").select("place", "sample", F.posexplode(F.concat(F.coalesce("given", F.array().cast(f"array<struct<kind:string,v:{VALUES[6:-1]}>>")), "own", "factors")).alias("pos", "t"))
    flat = all_.select("place", "sample", F.col("t.kind").alias("kind"), "pos", F.col("t.v.category.`@id`").alias("category_id"), F.col("t.v.value").alias("text"), F.col("t.v.unit.`@id`").alias("unit_id"))
    names = listed("characteristicCategories", f"`@id`:string,characteristicType:struct<{TERM}>", key, F.col("m.characteristicType.annotationValue").alias("named")).select("key", "named").unionByName(listed("factors", "`@id`:string,factorName:string", key, F.col("m.factorName").alias("named")).select("key", "named"))
    names = names.groupBy(F.col("key").alias("category_id")).agg(F.first("named", ignorenulls=True).alias("named"))
    term = lambda t: isa_value_of(t["annotationValue"], t["termSource"], F.coalesce(t["termAccession"], F.lit("")))
    units = listed("unitCategories", f"`@id`:string,{TERM}", key, term(F.col("m")).alias("unit")).select(F.col("key").alias("unit_id"), "unit").dropDuplicates(["unit_id"])
    parsed = F.when(F.startswith(F.trim("text"), F.lit("{")), F.from_json("text", TERM.replace(":", " ")))
    plain = F.struct(F.trim("text").alias("value"), *[F.lit(None).cast("string").alias(c) for c in ("accession", "term_source", "extra")])
    value = F.when(parsed.isNotNull(), term(parsed)).otherwise(plain)
    category = F.coalesce("named", F.regexp_extract("category_id", "([^/]*)$", 1))
    found = flat.join(names, "category_id", "left").join(units, "unit_id", "left")
    return found.select("place", "sample", "kind", "pos", category.alias("category"), value.alias("value"), "unit")
