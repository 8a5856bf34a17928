"""Queries that go through files: the driver's tables are written as imzML, mzML, sample tables, listings and archives, and read back by this library.

orders are spectra on a grid 64 wide and lineitem their points; every second line is a zero, so profiles have runs to mask.
"""

from __future__ import annotations

import base64
import json
import os
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions import cells
from peakloom.operators import folds, lookup, signal
from peakloom.plans import convert, corpus, export, fidelity
from peakloom.plans.catalogue import ORACLES, QUERIES, query, table
from peakloom.session import materialize, release, scratch_path
from peakloom.sources import archive, images, optical, samples, terms, xml

__all__ = ["ORACLES", "QUERIES"]

UUID = "00112233445566778899aabbccddeeff"
INTENSITY = "CASE WHEN l_linenumber % 2 = 0 THEN 0.0 ELSE l_quantity END"
LEVEL = "CASE left(o_orderpriority, 1) WHEN '5' THEN 0 ELSE CAST(left(o_orderpriority, 1) AS INTEGER) END"
KIND = "CASE o_orderstatus WHEN 'F' THEN 'profile' WHEN 'O' THEN 'centroid' ELSE 'unknown' END"
#: Files that a session has written, by application and tables.
MADE: dict[tuple, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one, which is on a file system that can be opened."""
    path = scratch_path(spark, name)
    path = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    os.makedirs(path)
    return path


def once(name: str):
    """Write a query's files once in a session."""
    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> str:
            key = (spark.sparkContext.applicationId, sf_dir, name)
            if key not in MADE:
                MADE[key] = f(spark, sf_dir, folder(spark, name))
            return MADE[key]

        return run

    return wrap


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("spectrum"), F.col("l_extendedprice").alias("mz"), F.expr(INTENSITY).alias("intensity"))
    zipped = F.sort_array(F.collect_list(F.struct("mz", "intensity")))
    arrays = points.groupBy(F.col("spectrum").alias("spectrum_index")).agg(zipped.alias("p")).select("spectrum_index", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))
    k = F.col("o_orderkey")
    heads = table(spark, sf_dir, "orders").select(k.alias("spectrum_index"), F.concat(F.lit("order="), k.cast("string")).alias("native_id"), (k % 64 + 1).alias("x"), (F.floor(k / 64) + 1).alias("y"), F.expr(LEVEL).alias("ms_level"), F.expr(KIND).alias("representation"))
    empty = F.array().cast("array<double>")
    return heads.join(arrays, "spectrum_index", "left").withColumns({"mz": F.coalesce("mz", empty), "intensity": F.coalesce("intensity", empty).cast("array<float>")})


def geometry(spark: SparkSession, sf_dir: str) -> dict:
    high = table(spark, sf_dir, "orders").agg(F.max(F.floor(F.col("o_orderkey") / 64) + 1)).first()[0]
    return {"grid_x": 64, "grid_y": high, "pixel_x": 12.5, "pixel_y": 25.0, "extent_x": 800, "scan_pattern": terms.SCAN_PATTERN}


@once("imzml")
def imzml(spark: SparkSession, sf_dir: str, at: str) -> str:
    export.export_imzml(spectra(spark, sf_dir), f"{at}/run", UUID, geometry(spark, sf_dir))
    return f"{at}/run"


@once("archive")
def converted(spark: SparkSession, sf_dir: str, at: str) -> str:
    run = imzml(spark, sf_dir)
    convert.convert(spark, f"{run}.imzML", f"{at}/archive")
    return f"{at}/archive"


FROM = f"""(SELECT o_orderkey AS spectrum, o_orderkey % 64 + 1 AS x, CAST(floor(o_orderkey / 64) AS BIGINT) + 1 AS y, greatest(1, {LEVEL}) AS ms_level, {KIND} AS representation FROM orders)"""
DOTS = f"(SELECT l_orderkey AS spectrum, l_extendedprice AS mz, {INTENSITY} AS intensity FROM lineitem)"
MASKED = f"""(SELECT spectrum, mz, intensity FROM (SELECT p.*, s.representation, coalesce(lag(intensity) OVER w, 0) AS a, coalesce(lead(intensity) OVER w, 0) AS b FROM {DOTS} p JOIN {FROM} s USING (spectrum) WINDOW w AS (PARTITION BY spectrum ORDER BY mz))
    WHERE representation <> 'profile' OR intensity <> 0 OR a <> 0 OR b <> 0)"""


def pixel_columns(df: DataFrame) -> DataFrame:
    size = F.coalesce(F.size("mz"), F.lit(0)).cast("long")
    return df.select(F.col("spectrum_index").alias("spectrum"), "x", "y", "ms_level", "representation", size.alias("n"), F.round(F.coalesce(signal.tic(F.col("intensity")), F.lit(0.0)), 4).alias("tic"), F.array_min("mz").alias("mz_lo"), F.array_max("mz").alias("mz_hi"))


@query(f"SELECT spectrum, x, y, ms_level, representation, count(mz) AS n, round(coalesce(sum(intensity), 0), 4) AS tic, min(mz) AS mz_lo, max(mz) AS mz_hi FROM {FROM} LEFT JOIN {DOTS} USING (spectrum) GROUP BY ALL")
def imzml_pixels(spark, sf_dir):
    """Export with layout and writing at places, then the scan of elements and sidecar."""
    run = imzml(spark, sf_dir)
    return pixel_columns(xml.read_imzml(spark, f"{run}.imzML", f"{run}.ibd"))


@query(f"SELECT TRUE AS uuid_ok, TRUE AS checksum_ok, TRUE AS ok, '{UUID}' AS uuid, 'sha1' AS checksum_type, 'processed' AS storage_mode")
def imzml_gate(spark, sf_dir):
    """The integrity gate and the header that it rests on."""
    run = imzml(spark, sf_dir)
    gate = xml.preflight(spark, f"{run}.imzML", f"{run}.ibd")
    return gate.withColumn("k", F.lit(1)).join(xml.read_header(spark, f"{run}.imzML").withColumn("k", F.lit(1)), "k").select("uuid_ok", "checksum_ok", "ok", "uuid", "checksum_type", "storage_mode")


@query("""SELECT 64 AS grid_x, max(CAST(floor(o_orderkey / 64) AS BIGINT) + 1) AS grid_y, 12.5 AS pixel_x, 25.0 AS pixel_y, 800 AS extent_x, CAST(NULL AS BIGINT) AS extent_y,
    TRUE AS has_pattern, FALSE AS has_type, TRUE AS has_pixel_size, FALSE AS has_extent FROM orders""")
def imzml_geometry(spark, sf_dir):
    """Geometry terms written and read again: what was absent stays absent, and a pair needs both axes."""
    found = xml.read_geometry(spark, f"{imzml(spark, sf_dir)}.imzML")
    block = archive.imaging_block(found).select(F.col("pixel_size").isNotNull().alias("has_pixel_size"), F.col("extent").isNotNull().alias("has_extent"), F.lit(1).alias("k"))
    own = found.select("grid_x", "grid_y", "pixel_x", "pixel_y", "extent_x", "extent_y", F.col("scan_pattern").isNotNull().alias("has_pattern"), F.col("scan_type").isNotNull().alias("has_type"), F.lit(1).alias("k"))
    return own.join(block, "k").drop("k")


@query("SELECT 'spectrum' AS kind, greatest(1, " + LEVEL + ") AS ms_level, count(*) AS n FROM orders GROUP BY ALL")
def inspected_levels(spark, sf_dir):
    """Counts of a file's spectra by level without reading an array."""
    return xml.inspect(spark, f"{imzml(spark, sf_dir)}.imzML").filter("kind = 'spectrum'")


@query(f"SELECT spectrum, x, y, ms_level, representation, count(mz) AS n, round(coalesce(sum(intensity), 0), 4) AS tic, min(mz) AS mz_lo, max(mz) AS mz_hi FROM {FROM} LEFT JOIN {MASKED} USING (spectrum) GROUP BY ALL")
def archive_pixels(spark, sf_dir):
    """The whole conversion: gate, scan, order, masking, facets, and the archive read by representation."""
    return pixel_columns(archive.pixels(spark, converted(spark, sf_dir)))


@query(f"SELECT count(*) AS spectra, 0 AS resorted, FALSE AS narrowed, 'float' AS intensity_width, count(*) FILTER ({LEVEL} = 0) AS remapped, 'ms1,msn' AS content, 'declared' AS grid_source, max(CAST(floor(o_orderkey / 64) AS BIGINT) + 1) AS grid_y, 'run' AS run_id, 'imzml,ibd' AS files FROM orders")
def archive_index(spark, sf_dir):
    """What the index says: counts, warnings, provenance, the reconciled grid and the run's references."""
    i = archive.read_index(spark, converted(spark, sf_dir))
    remapped = sum(w["n"] for w in i["warnings"] if w["kind"].startswith("MS level"))
    grid, m = i["metadata"]["imaging"]["grid"], i["metadata"]
    row = (i["spectra"], i["resorted"], i["narrowed"], i["intensity_width"], remapped, ",".join(i["content"]), grid["source"], grid["y"], m["run"]["id"], ",".join(f["id"] for f in m["source_files"]))
    return spark.createDataFrame([row], "spectra long, resorted int, narrowed boolean, intensity_width string, remapped long, content string, grid_source string, grid_y long, run_id string, files string")


GATES = "CAST(0 AS BIGINT) AS duplicate_source, CAST(0 AS BIGINT) AS duplicate_output, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS misplaced, CAST(0 AS BIGINT) AS mz_spectra, CAST(0 AS BIGINT) AS intensity_spectra, CAST(0 AS BIGINT) AS tic_spectra, CAST(0 AS BIGINT) AS geometry_fields"


@query(f"SELECT 'l1' AS level, count(*) AS n_source, count(*) AS n_output, {GATES}, TRUE AS equal FROM orders")
def fidelity_report(spark, sf_dir):
    """Source against archive, by place and representation, with the geometry of the archive exported again."""
    run, at = imzml(spark, sf_dir), converted(spark, sf_dir)
    again = f"{folder(spark, 'again')}/run"
    convert.convert(spark, at, again)
    pair = (xml.read_geometry(spark, f"{run}.imzML"), xml.read_geometry(spark, f"{again}.imzML"))  # read by now
    archive.delete(spark, os.path.dirname(again))
    heads = xml.imzml_rows(spark, f"{run}.imzML"), archive.facet_rows(spark, at, "spectra_metadata", archive.read_index(spark, at)["layout"])
    return fidelity.report(xml.read_imzml(spark, f"{run}.imzML", f"{run}.ibd"), archive.pixels(spark, at), fidelity.Level.L1, geometry=pair, keys=heads)


@query(f"""SELECT spectrum, CASE WHEN spectrum % 19 = 0 AND representation <> 'profile' THEN 0 ELSE f END AS place FROM
    (SELECT spectrum, representation, min(i) FILTER (intensity <> 0) AS f FROM (SELECT p.*, s.representation, row_number() OVER (PARTITION BY spectrum ORDER BY mz) - 1 AS i FROM {DOTS} p JOIN {FROM} s USING (spectrum)) GROUP BY 1, 2)
    WHERE (f IS NOT NULL AND spectrum % 17 = 0) OR (spectrum % 19 = 0 AND (f IS NOT NULL OR representation <> 'profile'))""")
def fidelity_damage(spark, sf_dir):
    """Spectra whose archived intensities or m/z were changed, and no others, are found, with the place of the first point that differs."""
    run, k = imzml(spark, sf_dir), F.col("spectrum_index")
    output = archive.pixels(spark, converted(spark, sf_dir)).withColumns({
        "intensity": F.when(k % 17 == 0, F.transform("intensity", lambda v: (v * 2).cast("float"))).otherwise(F.col("intensity")),
        "mz": F.when(k % 19 == 0, F.transform("mz", lambda v: v + 1)).otherwise(F.col("mz")),
    })
    found = fidelity.mismatches(xml.read_imzml(spark, f"{run}.imzML", f"{run}.ibd"), output, by="index")
    place = F.coalesce("mz_first", "intensity_first")
    return found.filter(place.isNotNull()).select(F.col("s_index").alias("spectrum"), place.alias("place"))


@query("SELECT 'l1' AS level, count(*) AS n_source, count(*) FILTER (o_orderkey % 23 <> 0) AS n_output, NULL AS missing, FALSE AS equal FROM orders")
def fidelity_counts(spark, sf_dir):
    """Counts that differ end the proof before an array is read."""
    run = imzml(spark, sf_dir)
    rows = xml.imzml_rows(spark, f"{run}.imzML").select("spectrum_index", "x", "y", "z", "representation", F.array().cast("array<double>").alias("mz"), F.array().cast("array<double>").alias("intensity"))
    return fidelity.report(rows, rows.filter("spectrum_index % 23 <> 0")).select("level", "n_source", "n_output", F.col("missing").cast("int").alias("missing"), "equal")


def encoded(values, kind: str) -> str:
    return base64.b64encode(zlib.compress(values.astype(kind).tobytes())).decode()


#: Spectra or traces in a document, about.
DOCUMENT = 1 << 15


def documents(rows: DataFrame) -> int:
    """Documents that rows are written as, a task's work each: the rows may lie in one file, and be little beside what is made of them."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // DOCUMENT))


@once("mzml")
def mzml(spark: SparkSession, sf_dir: str, at: str) -> str:
    """A run in parts, each a whole gzipped document with the same header; intensities of even spectra in 32 bits."""
    names = ["place", "value"]

    def run(batches):
        import numpy as np

        for b in batches:
            out = []
            for r in b.to_pylist():
                mz, intensity = np.array(r["mz"]), np.array(r["intensity"])
                width = (terms.FLOAT_32, "<f4") if r["spectrum_index"] % 2 == 0 else (terms.FLOAT_64, "<f8")
                shown = lambda a, v="", u="": f'<cvParam cvRef="MS" accession="{a}" name="n" value="{v}"{u}/>'
                part = lambda a, w, text: f'<binaryDataArray encodedLength="{len(text)}"><referenceableParamGroupRef ref="packed"/>{shown(a)}{shown(w)}<binary>{text}</binary></binaryDataArray>'
                kind = {"profile": shown(terms.PROFILE), "centroid": shown(terms.CENTROID)}.get(r["representation"], "")
                time = shown(terms.SCAN_START, r["spectrum_index"] / 8, f' unitAccession="{terms.MINUTE if r["spectrum_index"] % 3 == 0 else terms.SECOND}"')
                window = shown(terms.ISOLATION_TARGET, 500.5) + shown(terms.ISOLATION_LOWER, 0.5) + shown(terms.ISOLATION_UPPER, 1.5)
                second = f'<precursor spectrumRef="order={r["spectrum_index"] - 1}"><isolationWindow>{shown(terms.ISOLATION_TARGET, r["spectrum_index"] / 4)}</isolationWindow><selectedIonList><selectedIon>{shown(terms.CHARGE, 9)}</selectedIon><selectedIon><userParam name="ion" value="b"/></selectedIon></selectedIonList><activation/></precursor>' if r["ms_level"] > 3 else ""
                precursor = f'<precursorList count="1"><precursor><isolationWindow>{window}</isolationWindow><selectedIonList><selectedIon>{shown(terms.CHARGE, r["spectrum_index"] % 4)}</selectedIon></selectedIonList><activation>{shown(terms.COLLISION_ENERGY, 27.5)}</activation></precursor>{second}</precursorList>' if r["ms_level"] > 1 else ""
                own = shown("MS:1000129" if r["spectrum_index"] % 2 else "MS:1000130") + f'<userParam name="lot" type="xsd:int" value="{r["spectrum_index"] % 7}"/>'
                scan = time + shown("MS:1000512", f"line {r['spectrum_index']} &amp; more") + shown("MS:1000927", r["spectrum_index"] / 2, ' unitAccession="UO:0000028" unitName="millisecond"')
                mobility = f'<binaryDataArray encodedLength="0"><referenceableParamGroupRef ref="packed"/><cvParam cvRef="MS" accession="MS:1003007" name="raw ion mobility array" value=""/>{shown(terms.FLOAT_64)}<binary>{encoded(mz / 2, "<f8")}</binary></binaryDataArray>' if r["spectrum_index"] % 5 == 0 else ""
                arrays = part(terms.MZ_ARRAY, terms.FLOAT_64, encoded(mz, "<f8")) + part(terms.INTENSITY_ARRAY, width[0], encoded(intensity, width[1])) + mobility
                out.append((r["spectrum_index"], f'<spectrum index="{r["spectrum_index"]}" id="{r["native_id"]}" defaultArrayLength="{len(mz)}">{shown(terms.MS_LEVEL, r["ms_level"])}{kind}{own}<scanList count="1">{shown("MS:1000795")}<scan>{scan}</scan></scanList>{precursor}<binaryDataArrayList count="2">{arrays}</binaryDataArrayList></spectrum>'))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([v for _, v in out], pa.string())], names=names)

    head = f'<mzML><softwareList count="1"><software id="maker" version="7"/></softwareList><referenceableParamGroupList count="1"><referenceableParamGroup id="packed"><cvParam cvRef="MS" accession="{terms.ZLIB}" name="zlib compression" value=""/></referenceableParamGroup></referenceableParamGroupList><run id="made"><spectrumList>'

    def document(batches):
        yield pa.RecordBatch.from_arrays([pa.array([head])], names=["value"])
        yield from batches
        yield pa.RecordBatch.from_arrays([pa.array(["</spectrumList></run></mzML>"])], names=["value"])

    # dealt out before the elements are made, as ranges are told from a first pass over the rows
    stored = materialize(spectra(spark, sf_dir), "mzml-spectra")
    rows = stored.repartitionByRange(documents(stored), "spectrum_index").sortWithinPartitions("spectrum_index")
    rows.withColumn("intensity", F.col("intensity").cast("array<double>")).mapInArrow(run, "place long, value string").select("value").mapInArrow(document, "value string").write.option("compression", "gzip").text(f"{at}/run")
    release(stored)
    return f"{at}/run"


@query(f"""SELECT spectrum, ms_level, representation, round(spectrum / 8.0 * CASE WHEN spectrum % 3 = 0 THEN 60 ELSE 1 END, 6) AS rt, CASE WHEN spectrum % 2 = 0 THEN 'f32' ELSE 'f64' END AS intensity_type, n,
    round(tic, 4) AS tic, CASE WHEN given > 1 THEN spectrum % 4 END AS charge, CASE WHEN given > 1 THEN 2.0 END AS window_width, CASE WHEN given > 1 THEN 27.5 END AS energy, CASE WHEN spectrum % 5 = 0 THEN round(mz / 2, 3) END AS mobility
    FROM (SELECT s.spectrum, s.ms_level, s.representation, {LEVEL} AS given, count(p.mz) AS n, coalesce(sum(p.intensity), 0) AS tic, coalesce(sum(p.mz), 0) AS mz FROM {FROM} s JOIN orders ON s.spectrum = o_orderkey LEFT JOIN {DOTS} p ON p.spectrum = s.spectrum GROUP BY 1, 2, 3, 4)""")
def mzml_spectra(spark, sf_dir):
    """Inline arrays by base64 and zlib through a parameter group, source types, precursors and an ion mobility array."""
    s = xml.read_mzml(spark, mzml(spark, sf_dir))
    mobility = F.get(F.col("others"), F.lit(0))
    return s.select(
        F.col("spectrum_index").alias("spectrum"), "ms_level", "representation", F.round("rt_seconds", 6).alias("rt"), "intensity_type", F.size("mz").cast("long").alias("n"), F.round(signal.tic(F.col("intensity")), 4).alias("tic"),
        F.col("precursor.charge").cast("long").alias("charge"), (F.col("precursor.lower") + F.col("precursor.upper")).alias("window_width"), "precursor.energy", F.when(mobility["accession"] == "MS:1003007", F.round(signal.tic(mobility["values"]), 3)).alias("mobility"),
    )


@once("run-archive")
def archived_run(spark: SparkSession, sf_dir: str, at: str) -> str:
    convert.convert_run(spark, mzml(spark, sf_dir), f"{at}/archive", preset="lossless")
    return f"{at}/archive"


@query(f"""SELECT o_orderkey AS spectrum, CASE WHEN o_orderkey % 2 = 1 THEN 'negative' ELSE 'positive' END AS polarity, 'line ' || o_orderkey || ' & more' AS filter, o_orderkey / 2.0 AS injection, 'millisecond' AS unit, o_orderkey % 7 AS lot,
    'MS:1000795' AS combination, CASE WHEN {LEVEL} > 3 THEN 2 WHEN {LEVEL} > 1 THEN 1 ELSE 0 END AS precursors, CASE WHEN {LEVEL} > 3 THEN 'order=' || (o_orderkey - 1) END AS second_ref, CASE WHEN {LEVEL} > 3 THEN o_orderkey / 4.0 END AS second_target, CASE WHEN {LEVEL} > 3 THEN 'b' END AS second_ion FROM orders""")
def archived_parameters(spark, sf_dir):
    """Parameters of spectra, scans and precursors out of an archive: polarity, filter string, injection time, a user's own, and the second precursor."""
    a = archive.read_archive(spark, archived_run(spark, sf_dir))
    of = lambda params, accession, field="value": F.get(F.filter(params, lambda p: p["accession"] == accession), F.lit(0))[field]
    scan, second = F.get("scans", F.lit(0))["params"], F.get("precursors", F.lit(1))
    polarity = F.when(F.exists("params", lambda p: F.coalesce(p["accession"], F.lit("")) == "MS:1000129"), "negative").when(F.exists("params", lambda p: F.coalesce(p["accession"], F.lit("")) == "MS:1000130"), "positive")
    lot = F.get(F.filter("params", lambda p: p["accession"].isNull() & (p["name"] == "lot") & (p["type"] == "xsd:int")), F.lit(0))["value"]
    return a.select(
        F.col("spectrum_index").alias("spectrum"), polarity.alias("polarity"), of(scan, "MS:1000512").alias("filter"), of(scan, "MS:1000927").cast("double").alias("injection"), of(scan, "MS:1000927", "unit_name").alias("unit"), lot.cast("long").alias("lot"),
        F.get("combination", F.lit(0))["accession"].alias("combination"), F.size("precursors").alias("precursors"), second["ref"].alias("second_ref"), of(second["isolation"], terms.ISOLATION_TARGET).cast("double").alias("second_target"), F.get(F.get(second["ions"], F.lit(1)), F.lit(0))["value"].alias("second_ion"),
    )


@query(f"""SELECT spectrum, count(mz) AS n, round(coalesce(sum(mz), 0), 6) AS mz, round(coalesce(sum(intensity), 0), 4) AS tic FROM {FROM} LEFT JOIN {MASKED} USING (spectrum) GROUP BY 1""")
def lossless_archive(spark, sf_dir):
    """Chunks of m/z stored as differences of bit patterns, put together again."""
    a = archive.read_archive(spark, archived_run(spark, sf_dir))
    return a.select(F.col("spectrum_index").alias("spectrum"), F.size("mz").cast("long").alias("n"), F.round(signal.tic(F.col("mz")), 6).alias("mz"), F.round(signal.tic(F.col("intensity")), 4).alias("tic"))


@query(f"""SELECT spectrum, round(sum(intensity), 4) AS tic, count(*) AS n FROM {MASKED} WHERE mz BETWEEN 20000 AND 30000 GROUP BY 1""")
def archived_window(spark, sf_dir):
    """A window of m/z from an archive's chunks: the others are pruned by their bounds."""
    rows = archive.window_rows(spark, archived_run(spark, sf_dir), 20000.0, 30000.0)
    inside = F.filter(F.arrays_zip("mz", "intensity"), lambda p: p["mz"].between(20000.0, 30000.0))
    part = rows.select("spectrum_index", inside.alias("p")).filter(F.size("p") > 0)
    return part.groupBy(F.col("spectrum_index").alias("spectrum")).agg(F.round(F.sum(signal.tic(F.col("p.intensity"))), 4).alias("tic"), F.sum(F.size("p")).cast("long").alias("n"))


@once("traces")
def traces(spark: SparkSession, sf_dir: str, at: str) -> str:
    """parts as traces of reactions, in several documents without a spectrum."""
    def run(batches):
        import numpy as np

        yield pa.RecordBatch.from_arrays([pa.array(["<mzML><run><chromatogramList>"])], names=["value"])
        for b in batches:
            out = []
            for r in b.to_pylist():
                k, n = r["p_partkey"], r["p_size"]
                shown = lambda a, v="": f'<cvParam cvRef="MS" accession="{a}" name="n" value="{v}"/>'
                part = lambda a, w, kind, v: f'<binaryDataArray encodedLength="0">{shown(a)}{shown(w)}{shown(terms.ZLIB)}<binary>{encoded(v, kind)}</binary></binaryDataArray>'
                ends = "".join(f"<{tag}><isolationWindow>{shown(terms.ISOLATION_TARGET, v)}</isolationWindow>{more}</{tag}>" for tag, v, more in (("precursor", k + 0.5, f"<activation>{shown(terms.COLLISION_ENERGY, n)}</activation>"), ("product", k / 2, "")))
                flags = f'<binaryDataArray encodedLength="0"><cvParam accession="MS:1000786" name="non-standard data array" value="level"/>{shown(terms.INTEGER_64)}{shown(terms.ZLIB)}<binary>{encoded(np.arange(n) + 2**60 + k, "<i8")}</binary></binaryDataArray>'
                arrays = part(terms.TIME_ARRAY, terms.FLOAT_64, "<f8", np.arange(n) / 4) + part(terms.INTENSITY_ARRAY, terms.FLOAT_32, "<f4", np.arange(n) * 1.0 + k % 10) + flags
                out.append(f'<chromatogram index="{k}" id="part {k}" defaultArrayLength="{n}">{shown("MS:1001473")}{ends}<binaryDataArrayList count="3">{arrays}</binaryDataArrayList></chromatogram>')
            yield pa.RecordBatch.from_arrays([pa.array(out)], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["</chromatogramList></run></mzML>"])], names=["value"])

    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    parts.repartition(documents(parts)).mapInArrow(run, "value string").write.text(f"{at}/traces")
    convert.convert_run(spark, f"{at}/traces", f"{at}/archive")
    return f"{at}/archive"


@query("""SELECT p_partkey AS trace, 'part ' || p_partkey AS id, p_size AS n, (p_size - 1) / 4.0 AS ends, p_size * (p_size - 1) / 2.0 + p_size * (p_partkey % 10) AS total, p_partkey + 0.5 AS precursor, CAST(p_size AS DOUBLE) AS energy, p_partkey / 2.0 AS product,
    'MS:1001473' AS kind, 1152921504606846976 + p_partkey + p_size - 1 AS last_level FROM part""")
def archived_traces(spark, sf_dir):
    """Traces with their precursor, product and a whole-number array out of an archive."""
    t = archive.read_chromatograms(spark, traces(spark, sf_dir))
    of = lambda params, accession: F.get(F.filter(params, lambda p: p["accession"] == accession), F.lit(0))["value"].cast("double")
    return t.select(
        F.col("chrom_index").alias("trace"), "id", F.size("time").alias("n"), F.element_at("time", -1).alias("ends"), signal.tic(F.col("intensity")).alias("total"), of(F.col("precursor.isolation"), terms.ISOLATION_TARGET).alias("precursor"), of(F.col("precursor.activation"), terms.COLLISION_ENERGY).alias("energy"),
        of(F.col("product"), terms.ISOLATION_TARGET).alias("product"), F.get("params", F.lit(0))["accession"].alias("kind"), F.element_at(F.get("others", F.lit(0))["integers"], -1).alias("last_level"),
    )


@query(f"""SELECT (SELECT count(*) FROM orders) AS spectra, 'double' AS intensity_width, FALSE AS narrowed, (SELECT count(*) FROM {MASKED}) AS points, (SELECT round(sum(mz) / 2, 1) FROM {MASKED} WHERE spectrum % 5 = 0) AS mobility, 'maker,peakloom' AS software""")
def mzml_archive(spark, sf_dir):
    """A run in an archive at the source's width; arrays beside m/z are masked along with it, and the source's software is listed before ours."""
    at = f"{folder(spark, 'run-archive')}/archive"
    index = convert.convert_run(spark, mzml(spark, sf_dir), at)
    back = archive.read_archive(spark, at)
    other = F.aggregate(F.flatten("others.values"), F.lit(0.0), lambda s, v: s + v)
    sums = back.agg(F.sum(F.size("mz")).alias("points"), F.round(F.sum(F.when(F.size("others") > 0, other)), 1).alias("mobility"))
    said = [F.lit(index["spectra"]).cast("long").alias("spectra"), F.lit(index["intensity_width"]).alias("intensity_width"), F.lit(index["narrowed"]).alias("narrowed")]
    return sums.select(*said, "points", "mobility", F.lit(",".join(s["id"] for s in index["metadata"]["software"])).alias("software"))


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as ascending m/z axes."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("spectrum_index"), F.array_sort(F.transform("embedding", lambda v: F.abs(v.cast("double")) * 500 + 100)).alias("mz"))


@query("SELECT vec_id, len(embedding) AS n, TRUE AS within FROM embeddings")
def numpress_bound(spark, sf_dir):
    """m/z coded with loss and decoded: no value is off by more than the contract allows."""
    a = axes(spark, sf_dir)
    back = archive.coded(archive.coded(a, encode=True), encode=False)
    both = a.withColumnRenamed("mz", "was").join(back, "spectrum_index")
    off = F.array_max(F.zip_with("was", "mz", lambda x, y: F.abs(x - y) / x))
    return both.select(F.col("spectrum_index").alias("vec_id"), F.size("mz").cast("long").alias("n"), (off <= 1e-7).alias("within"))


@query("SELECT vec_id, len(embedding) AS n, TRUE AS within FROM embeddings")
def delta_round_trip(spark, sf_dir):
    """Differences of bit patterns and their running sums: every value comes back, bit for bit."""
    both = axes(spark, sf_dir).withColumn("back", signal.from_bit_deltas(signal.bit_deltas(F.col("mz"))))
    return both.select(F.col("spectrum_index").alias("vec_id"), F.size("back").cast("long").alias("n"), (F.col("mz") == F.col("back")).alias("within"))


@query("""SELECT vec_id, i - 1 AS place, round(m, 6) AS mz, round(d, 6) AS mobility, round(v, 6) AS intensity FROM (SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY m, d, k) AS i, m, d, v FROM
    (SELECT vec_id, k, round(CAST(embedding[k] AS DOUBLE), 1) AS m, CAST(embedding[65 - k] AS DOUBLE) AS d, CAST(embedding[k] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS k FROM embeddings)))""")
def mobility_order(spark, sf_dir):
    """Three parallel arrays by m/z, then mobility."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(v, lambda x: F.round(x, 1)).alias("m"), F.reverse(v).alias("d"), v.alias("v"))
    got = rows.select("vec_id", signal.sort_with_mobility(F.col("m"), F.col("d"), F.col("v")).alias("s"))
    flat = got.select("vec_id", F.posexplode(F.arrays_zip("s.mz", "s.mobility", "s.intensity")).alias("place", "p"))
    return flat.select("vec_id", F.col("place").cast("long").alias("place"), *[F.round(f"p.{c}", 6).alias(c) for c in ("mz", "mobility", "intensity")])


@query("""WITH c AS (SELECT c_custkey AS k, c_nationkey % 12 + 1 AS x, CAST(abs(c_acctbal) / 500 AS INTEGER) AS y, c_acctbal AS tic FROM customer)
    SELECT (SELECT count(*) FROM c WHERE NOT (x BETWEEN 1 AND 10 AND y BETWEEN 1 AND 15)) AS dropped, 150 AS cells, count(*) AS present, round(sum(tic), 2) AS total
    FROM (SELECT x, y, arg_max(tic, k) AS tic FROM c WHERE x BETWEEN 1 AND 10 AND y BETWEEN 1 AND 15 GROUP BY 1, 2)""")
def grid_pivot(spark, sf_dir):
    """Sums on a dense grid: the last of several on a cell counts, what lies outside is counted and left out."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 12 + 1).alias("x"), F.rint(F.abs("c_acctbal") / 500).cast("int").alias("y"), F.col("c_acctbal").alias("tic"))
    cells_, lost = signal.image_grid(rows, "k", 10, 15)
    sums = cells_.agg(F.count(F.lit(1)).cast("int").alias("cells"), F.count_if("present").alias("present"), F.round(F.sum("tic"), 2).alias("total"), F.lit(1).alias("k"))
    return lost.withColumn("k", F.lit(1)).join(sums, "k").drop("k")


@once("sdrf")
def sdrf(spark: SparkSession, sf_dir: str, at: str) -> str:
    """customers as a sample table: ragged rows, a Windows path, quotes, N/A cells."""
    rows = table(spark, sf_dir, "customer").orderBy("c_custkey").select(F.concat_ws(
        "\t", F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")), F.when(F.col("c_custkey") % 4 == 0, "not available").otherwise(F.concat(F.lit("NT="), F.col("c_name"), F.lit(";AC=X:"), F.col("c_nationkey").cast("string"))),
        F.concat(F.lit("C:\\d\\run"), (F.col("c_custkey") % 50).cast("string"), F.lit(".x.raw")), F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit("TMT12"), (F.col("c_custkey") % 3 + 6).cast("string"))),
    ).alias("line")).collect()
    with open(f"{at}/table.sdrf.tsv", "w", encoding="utf-8") as f:  # one file, as sample tables are
        f.write("source name\tcharacteristics[who]\tcomment[data file]\tcomment[label]\n\n")
        f.writelines(r["line"] + "\n" for r in rows)
    return f"{at}/table.sdrf.tsv"


FIRST = "(SELECT s, row_number() OVER (ORDER BY f) AS n FROM (SELECT c_mktsegment || '/' || c_nationkey AS s, min(c_custkey) AS f FROM customer GROUP BY 1))"


@query(f"""SELECT r.run, count(k) AS rows, coalesce(string_agg('sample-' || n, ',' ORDER BY first), '') AS samples, CASE WHEN sum(m) IS NULL THEN 'no row' WHEN sum(m) > 1 THEN 'several rows' END AS diagnostic
    FROM (SELECT 'runs/run' || range || '.x.mzML' AS run, range AS k0 FROM range(55)) r LEFT JOIN
    (SELECT c_custkey % 50 AS k, n, min(c_custkey) AS first, count(*) AS m FROM customer JOIN {FIRST} ON s = c_mktsegment || '/' || c_nationkey GROUP BY 1, 2) ON k = k0 GROUP BY 1""")
def sample_bindings(spark, sf_dir):
    """A sample table read from its file; runs bound to the ordered distinct samples of the rows with their stem."""
    cells_ = samples.read_table(spark, sdrf(spark, sf_dir))
    runs = spark.range(55).select(F.concat(F.lit("runs/run"), F.col("id").cast("string"), F.lit(".x.mzML")).alias("path"))
    bound = samples.bind_runs(runs, cells_)
    return bound.select(F.col("path").alias("run"), F.size("sample_ids").cast("long").alias("rows"), F.array_join("sample_ids", ",").alias("samples"), "diagnostic")


@query(f"""SELECT 'sample-' || n AS sample_id, s AS name, CASE WHEN f % 4 = 0 THEN 'not available' ELSE c_name END AS who, f % 4 = 0 AS is_na, CASE WHEN f % 4 <> 0 THEN 'X:' || c_nationkey END AS accession
    FROM (SELECT c_mktsegment || '/' || c_nationkey AS s, min(c_custkey) AS f FROM customer GROUP BY 1) JOIN {FIRST} USING (s) JOIN customer ON c_custkey = f""")
def sample_traits(spark, sf_dir):
    """Samples by their first row, with typed characteristics."""
    found = samples.samples(samples.read_table(spark, sdrf(spark, sf_dir)))
    c = F.get("characteristics", F.lit(0))["cell"]
    return found.select("sample_id", "name", c["value"].alias("who"), c["is_na"].alias("is_na"), c["accession"].alias("accession"))


@query("""SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx, 'assay-' || row_number() OVER (ORDER BY c_custkey) AS assay_id, c_mktsegment || '/' || c_nationkey AS sample, CASE WHEN c_custkey % 3 > 0 THEN 'TMT12' || (c_custkey % 3 + 6) ELSE '' END AS label,
    CASE WHEN c_custkey % 3 = 1 THEN 127.124761 WHEN c_custkey % 3 = 2 THEN 128.128116 END AS target FROM customer""")
def sample_assays(spark, sf_dir):
    """One assay a row, numbered where it has no name, with its channel."""
    rows = samples.channels(spark, samples.assays(samples.read_table(spark, sdrf(spark, sf_dir))))
    return rows.select("row_idx", "assay_id", "sample", "label", "target")


@once("isa")
def isa(spark: SparkSession, sf_dir: str, at: str) -> str:
    """suppliers as an ISA-Tab bundle whose investigation names its files."""
    rows = table(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_suppkey", "s_name", "s_nationkey").collect()
    with open(f"{at}/i_made.txt", "w") as f:
        f.write('ONTOLOGY SOURCE REFERENCE\nTerm Source Name\t"EFO"\t"OBI"\nINVESTIGATION\nInvestigation Identifier\t"I1"\nSTUDY\nStudy Identifier\t""\nStudy Title\t"The study"\nStudy File Name\t"s_one.txt"\nSTUDY ASSAYS\nStudy Assay File Name\t"a_even.txt"\t"a_odd.txt"\n')
    with open(f"{at}/s_one.txt", "w") as f:
        f.write('"Source Name"\t"Characteristics[nation]"\t"Term Source REF"\t"Term Accession Number"\t"Sample Name"\t"Factor Value[half]"\n')
        f.writelines(f'"src{r["s_nationkey"]}"\t"nation {r["s_nationkey"]}"\t"EFO"\t"{"http://x/" if r["s_suppkey"] % 2 else "EFO:"}{r["s_nationkey"]}"\t"{r["s_name"]}"\t"{"low" if r["s_nationkey"] < 12 else "high"}"\n' for r in rows)
    for half, name in ((0, "a_even.txt"), (1, "a_odd.txt")):
        with open(f"{at}/{name}", "w") as f:
            f.write('"Sample Name"\t"MS Assay Name"\t"Raw Spectral Data File"\t"Derived Spectral Data File"\n')
            f.writelines(f'"{r["s_name"]}"\t""\t"FILES/run{r["s_suppkey"] % 20}.raw"\t"run{r["s_suppkey"] % 20}.mzML"\n' for r in rows if r["s_suppkey"] % 2 == half)
    return at


@query("""SELECT 'run' || k || '.mzML' AS run, coalesce(string_agg(s_name, ',' ORDER BY s_suppkey), '') AS samples, CASE WHEN count(s_name) = 0 THEN 'no row' WHEN count(s_name) > 1 THEN 'several rows' END AS diagnostic
    FROM (SELECT range AS k FROM range(22)) LEFT JOIN supplier ON s_suppkey % 20 = k GROUP BY k""")
def isa_bindings(spark, sf_dir):
    """Assays of the files that an investigation names, bound to runs by any of their data files."""
    files = samples.locate_isa(isa(spark, sf_dir))
    runs = spark.range(22).select(F.concat(F.lit("run"), F.col("id").cast("string"), F.lit(".mzML")).alias("path"))
    bound = samples.bind_isa_runs(runs, samples.isa_assays([samples.read_table(spark, f) for f in files["assays"]]))
    return bound.select(F.col("path").alias("run"), F.array_join("samples", ",").alias("samples"), "diagnostic")


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS row_idx, 'nation ' || s_nationkey AS value, CASE WHEN s_suppkey % 2 = 0 THEN 'EFO:' || s_nationkey END AS accession, CASE WHEN s_suppkey % 2 = 1 THEN 'http://x/' || s_nationkey END AS extra, 'EFO' AS term_source FROM supplier")
def isa_traits(spark, sf_dir):
    """Values with the term columns that follow them; an address is no accession and stays beside it."""
    found = samples.isa_traits(samples.read_table(spark, samples.locate_isa(isa(spark, sf_dir))["studies"][0])).filter("category = 'nation'")
    return found.select("row_idx", "value.value", "value.accession", "value.extra", "value.term_source")


@query("SELECT 'I1' AS accession, 'The study' AS title, 'EFO,OBI' AS ontologies, 'a_even.txt,a_odd.txt' AS assays")
def isa_study(spark, sf_dir):
    """An investigation's identity, the study's before its own, the ontologies and files that it names."""
    blocks = samples.isa_blocks(spark, samples.locate_isa(isa(spark, sf_dir))["investigation"])
    names = samples.isa_values(blocks, "STUDY ASSAYS", "Study Assay File Name").agg(F.array_join(F.sort_array(F.collect_list("value")), ",").alias("assays"), F.lit(1).alias("k"))
    known = samples.isa_ontologies(blocks).agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("ontologies"), F.lit(1).alias("k"))
    return samples.isa_identity(blocks).withColumn("k", F.lit(1)).join(known, "k").join(names, "k").drop("k")


@query("""SELECT 'sample-' || row_number() OVER (ORDER BY s_suppkey) AS sample_id, s_name AS name, 'src' || s_nationkey AS source, CASE WHEN s_nationkey < 12 THEN 'low' ELSE 'high' END AS half FROM supplier""")
def isa_samples(spark, sf_dir):
    """A study table's samples by sample name, with their sources and factor values."""
    cells_ = samples.read_table(spark, samples.locate_isa(isa(spark, sf_dir))["studies"][0])
    named = samples.column(samples.unquoted(cells_), "sample name").withColumnRenamed("value", "name")
    half = samples.isa_traits(cells_).filter("category = 'half'").select("row_idx", F.col("value.value").alias("half"))
    return samples.isa_study_samples(cells_).join(named, "name").join(half, "row_idx").select("sample_id", "name", "source", "half")


@query("""SELECT 'run' || s_suppkey % 10 || '.raw' AS file, CASE WHEN s_suppkey % 3 = 2 THEN '#gone' || s_suppkey ELSE s_name END AS sample, CASE WHEN s_suppkey % 3 = 2 THEN 'unresolved' END AS diagnostic FROM supplier""")
def isa_json_files(spark, sf_dir):
    """An ISA-JSON document's process graph: data files with the samples or sources that go into them."""
    rows = table(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_suppkey", "s_name").collect()
    listed = lambda rest, tag: [{"@id": f"#{tag}{r['s_suppkey']}", "name": r["s_name"]} for r in rows if r["s_suppkey"] % 3 == rest]
    step = lambda r: {"@id": f"#p{r['s_suppkey']}", "inputs": [{"@id": f"#{('smp', 'src', 'gone')[r['s_suppkey'] % 3]}{r['s_suppkey']}"}], "outputs": [{"@id": f"#f{r['s_suppkey'] % 10}"}]}
    doc = {"identifier": "I1", "studies": [{"materials": {"samples": listed(0, "smp"), "sources": listed(1, "src")}, "assays": [{"filename": "a", "dataFiles": [{"@id": f"#f{k}", "name": f"run{k}.raw"} for k in range(10)], "processSequence": [step(r) for r in rows]}]}]}
    path = f"{folder(spark, 'isa-json')}/i.json"
    with open(path, "w") as f:
        json.dump(doc, f)
    return samples.isa_files(samples.read_isa_json(spark, path))


@once("isa-values")
def isa_values_json(spark: SparkSession, sf_dir: str, at: str) -> str:
    """The suppliers of `isa` as an ISA-JSON document: nations are the sources', halves factor values, balances have a unit."""
    rows = table(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_suppkey", "s_name", "s_nationkey", F.col("s_acctbal").cast("string").alias("balance")).toLocalIterator()
    sources, found = {}, []
    for r in rows:
        k, n = r["s_suppkey"], r["s_nationkey"]
        term = {"annotationValue": f"nation {n}", "termSource": "EFO", "termAccession": ("http://x/" if k % 2 else "EFO:") + str(n)}
        sources[k] = {"@id": f"#source/{k}", "name": f"src{n}", "characteristics": [{"category": {"@id": "#category/1"}, "value": term}]}
        own = [{"category": {"@id": "#characteristic_category/balance"}, "value": float(r["balance"]), "unit": {"@id": "#unit/eur"}}]
        found.append({"@id": f"#sample/{k}", "name": r["s_name"], "derivesFrom": [{"@id": f"#source/{k}"}], "characteristics": own, "factorValues": [{"category": {"@id": "#factor/half"}, "value": {"annotationValue": "low" if n < 12 else "high"}}]})
    study = {"materials": {"sources": list(sources.values()), "samples": found}, "characteristicCategories": [{"@id": "#category/1", "characteristicType": {"annotationValue": "nation"}}], "factors": [{"@id": "#factor/half", "factorName": "half"}], "unitCategories": [{"@id": "#unit/eur", "annotationValue": "euro", "termSource": "UO", "termAccession": "UO:7"}], "assays": []}
    with open(f"{at}/i.json", "w") as f:
        json.dump({"identifier": "I1", "studies": [study]}, f)
    return f"{at}/i.json"


@query("""SELECT s_name AS sample, 0 AS pos, 'nation' AS category, 'nation ' || s_nationkey AS value, CASE WHEN s_suppkey % 2 = 0 THEN 'EFO:' || s_nationkey END AS accession, CASE WHEN s_suppkey % 2 = 1 THEN 'http://x/' || s_nationkey END AS extra, NULL AS unit, NULL AS amount FROM supplier
    UNION ALL SELECT s_name, 1, 'balance', NULL, NULL, NULL, 'UO:7', s_acctbal FROM supplier UNION ALL SELECT s_name, 2, 'half', CASE WHEN s_nationkey < 12 THEN 'low' ELSE 'high' END, NULL, NULL, NULL, NULL FROM supplier""")
def isa_json_values(spark, sf_dir):
    """Characteristics of sources and samples and factor values of an ISA-JSON document, with categories and units resolved."""
    found = samples.isa_json_traits(samples.read_isa_json(spark, isa_values_json(spark, sf_dir)))
    number = F.col("category") == "balance"
    return found.select("sample", "pos", "category", F.when(~number, F.col("value.value")).alias("value"), "value.accession", "value.extra", F.col("unit.accession").alias("unit"), F.when(number, F.col("value.value").cast("double")).alias("amount"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/tiff' WHEN 2 THEN 'image/jpeg' END AS media_type, CASE WHEN p_partkey % 4 < 3 THEN p_size END AS width, CASE WHEN p_partkey % 4 < 3 THEN p_size * 2 + 1 END AS height FROM part""")
def image_headers(spark, sf_dir):
    """Format and size from the headers of PNG, TIFF and JPEG files; anything else is none."""
    k, w, h = F.col("p_partkey"), F.col("p_size"), F.col("p_size") * 2 + 1
    wide = lambda v, n: F.lpad(F.hex(v), n, "0")
    little = lambda v: F.concat(*[F.substring(wide(v, 8), 7 - 2 * j, 2) for j in range(4)])
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), wide(w, 8), wide(h, 8))
    tiff = F.concat(F.lit("49492A00080000000200"), F.lit("0001040001000000"), little(w), F.lit("0101040001000000"), little(h))
    jpeg = F.concat(F.lit("FFD8FFE000041234FFC0000B08"), wide(h, 4), wide(w, 4), F.lit("01011100"))
    content = F.unhex(F.when(k % 4 == 0, png).when(k % 4 == 1, tiff).when(k % 4 == 2, jpeg).otherwise(F.hex("p_name")))
    got = images.image_headers(table(spark, sf_dir, "part").select(k.cast("string").alias("path"), content.alias("content")))
    return got.select(F.col("path").cast("long").alias("p_partkey"), "media_type", "width", "height")


@query("""SELECT 'n' || n_nationkey AS sample, n_regionkey + 1 AS references_, CASE n_nationkey % 3 WHEN 0 THEN '/d/in/p.tif' WHEN 1 THEN '/abs/p.tif' END AS first_path, n_name AS staining FROM nation""")
def optical_references(spark, sf_dir):
    """Locations in a header's samples open references, the terms after them belong to those; each location is resolved safely."""
    shown = lambda a, v="": f'<cvParam accession="{a}" name="n" value="{v}"/>'
    text = ""
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        at = ("in/p.tif", "file://host/abs/p.tif", "../p.tif")[r["n_nationkey"] % 3]
        text += f'<sample id="n{r["n_nationkey"]}">{shown(optical.MORPHOLOGY, "before any")}{shown(optical.LOCATION, at)}{shown(optical.STAINING, r["n_name"])}{shown(optical.LOCATION, "x") * r["n_regionkey"]}</sample>'
    path = f"{folder(spark, 'optical')}/run.imzML"
    with open(path, "w") as f:
        f.write(f"<mzML><sampleList>{text}</sampleList><run><spectrumList></spectrumList></run></mzML>")
    first = optical.read_optical(spark, path).groupBy("sample").agg(F.count(F.lit(1)).cast("int").alias("references_"), F.min_by(F.struct("location", "staining"), "ordinal").alias("f"))
    return first.select("sample", "references_", optical.resolve_location(F.col("f.location"), F.lit("/d")).alias("first_path"), F.col("f.staining").alias("staining"))


@query("SELECT 'nation/' || n_name AS name, sha256(n_name || chr(10)) AS sha256, CAST(length(n_name) + 1 AS BIGINT) AS size_bytes, TRUE AS same FROM nation")
def kept_members(spark, sf_dir):
    """Files kept in an archive: digest, size, and the bytes when one is taken out again."""
    at = folder(spark, "members")
    rows = [r["n_name"] for r in table(spark, sf_dir, "nation").select("n_name").collect()]
    for n in rows:
        with open(f"{at}/{n}", "w") as f:
            f.write(n + "\n")
    none = spark.createDataFrame([], "spectrum_index long, representation string, mz array<double>, intensity array<double>")
    archive.write_archive(none, f"{at}/archive", members=archive.member_rows(spark, {f"nation/{n}": f"{at}/{n}" for n in rows}))
    one = archive.extract_member(spark, f"{at}/archive", rows[0]) == (rows[0] + "\n").encode()
    kept = spark.read.parquet(f"{at}/archive/facet=members")
    same = F.col("content") == F.concat(F.substring_index("name", "/", -1), F.lit("\n")).cast("binary")
    return kept.select("name", "sha256", "size_bytes", (same & F.lit(one)).alias("same"))


OBJECTS = "(SELECT CASE WHEN page_id % 10 = 0 THEN 'index' || page_id || '.html' WHEN page_id % 10 = 1 THEN 'README.md' WHEN page_id % 10 = 2 THEN 'demo/x/' || page_id WHEN page_id % 10 = 3 THEN 'set3/README.md' ELSE 'set' || page_id % 4 || '/d' || page_id % 7 || '/f' || page_id || CASE page_id % 3 WHEN 0 THEN '.raw' WHEN 1 THEN '.mzML' ELSE '.archive' END END AS key, octet_length(encode(coalesce(html, ''))) AS size FROM pages)"
FILES = f"(SELECT split_part(key, '/', 1) AS subset, split_part(key, '/', 1) || '/' || split_part(key, '/', 2) AS dataset, split_part(key, '/', 3) AS rel, key, size FROM {OBJECTS} WHERE key LIKE 'set%/d%')"


@once("listing")
def listing(spark: SparkSession, sf_dir: str, at: str) -> str:
    k = F.col("page_id")
    t = lambda c: c.cast("string")
    deep = F.concat(F.lit("set"), t(k % 4), F.lit("/d"), t(k % 7), F.lit("/f"), t(k), F.when(k % 3 == 0, ".raw").when(k % 3 == 1, ".mzML").otherwise(".archive"))
    key = F.when(k % 10 == 0, F.concat(F.lit("index"), t(k), F.lit(".html"))).when(k % 10 == 1, "README.md").when(k % 10 == 2, F.concat(F.lit("demo/x/"), t(k))).when(k % 10 == 3, "set3/README.md").otherwise(deep)
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("long")
    page = table(spark, sf_dir, "pages").groupBy(F.floor(k / 500)).agg(F.collect_list(F.struct(key.alias("Key"), size.alias("Size"))).alias("Contents"))
    page.select(F.to_json(F.struct("Contents")).alias("value")).write.text(f"{at}/pages")  # a store lists some hundred objects a page
    return f"{at}/pages"


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.read_listing(spark, listing(spark, sf_dir), hidden=("demo",))


@query(f"""SELECT subset, count(DISTINCT dataset) AS datasets, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM {FILES} GROUP BY 1
    UNION ALL SELECT NULL, count(DISTINCT dataset), count(*), CAST(sum(size) AS BIGINT) FROM {FILES} WHERE subset <> 'set2'""")
def listing_totals(spark, sf_dir):
    """An object store's listing: what is data, by subset, and the totals of the listed subsets."""
    return folds.group_totals(listed(spark, sf_dir), "subset", "dataset", "size", ["set2"])


@query(f"SELECT key, row_number() OVER (PARTITION BY dataset ORDER BY CASE WHEN lower(rel) LIKE '%.archive' THEN 0 ELSE 1 END, lower(rel), rel) AS place, CASE WHEN rel LIKE '%.raw' THEN 'raw' WHEN rel LIKE '%.mzML' THEN 'mzml' ELSE 'archive' END AS tag FROM {FILES}")
def listing_places(spark, sf_dir):
    """Files of each dataset in listing order, with their tags."""
    return corpus.tag_files(folds.listing_order(listed(spark, sf_dir), "dataset", "rel")).select("key", F.col("place").cast("long").alias("place"), "tag")


SUBSETS = [("set0", "zero", "The first", None), ("set1", None, None, True), ("set9", "nine", "Unused", False)]


@query(f"""WITH t AS (SELECT subset, dataset, CAST(sum(CASE WHEN rel LIKE '%.raw' THEN size ELSE 0 END) AS BIGINT) AS vendor, CAST(sum(CASE WHEN rel LIKE '%.mzML' THEN size ELSE 0 END) AS BIGINT) AS spectra, CAST(sum(CASE WHEN rel LIKE '%.archive' THEN size ELSE 0 END) AS BIGINT) AS archive FROM {FILES} GROUP BY 1, 2),
    r AS (SELECT CASE subset WHEN 'set0' THEN 'zero' ELSE subset END AS category_slug, CASE subset WHEN 'set0' THEN 'The first' ELSE subset END AS category_title, split_part(dataset, '/', 2) AS dataset, CASE WHEN subset = 'set1' THEN 0 ELSE vendor END AS raw_b, CASE WHEN subset = 'set1' THEN 0 ELSE spectra END AS xml_b, archive AS archive_b FROM t)
    SELECT *, CASE WHEN raw_b > 0 THEN raw_b ELSE xml_b END AS input_b FROM r""")
def corpus_ratios(spark, sf_dir):
    """The ratios table, written as tab-separated text and read again."""
    known = spark.createDataFrame(SUBSETS, "subset string, slug string, title string, imaging boolean")
    at = f"{folder(spark, 'ratios')}/ratios"
    corpus.write_tsv(corpus.ratios(listed(spark, sf_dir), known), at, ["category_slug", "dataset"])
    return spark.read.csv(at, sep="\t", header=True, schema="category_slug string, category_title string, dataset string, raw_b long, xml_b long, archive_b long, input_b long")


@query("""SELECT 'data/' || p AS path, CAST(n AS BIGINT) AS bytes, CASE WHEN doc_id % 3 = 0 THEN 'Y' ELSE 'N' END AS stored, CASE WHEN doc_id % 3 = 0 THEN 'sync' WHEN lang = 'en' THEN 'fetch english' ELSE 'no recorded source' END AS recover_via
    FROM (SELECT doc_id, lang, n_chars AS n, coalesce(lang, 'none') || '/' || doc_id AS p FROM documents)""")
def recovery_manifest(spark, sf_dir):
    """Local files against the store's keys, with where each comes from."""
    key = F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string"))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("data/"), key).alias("path"), key.alias("key"), F.col("n_chars").cast("long").alias("bytes"), "doc_id")
    recover = spark.createDataFrame([("en", "fetch english"), ("gone", "nowhere")], "top string, source string")
    return corpus.manifest(files.drop("doc_id"), files.filter("doc_id % 3 = 0").select("key"), recover, "sync")


REPORTS = "(SELECT user_id, event_type AS rule, CASE WHEN value < 30 THEN 'error' WHEN value < 60 THEN 'warning' ELSE 'info' END AS level FROM events)"


@query(f"SELECT rule, count(DISTINCT user_id) AS n, CASE rule WHEN 'view' THEN 'seen before' ELSE 'not classified' END AS cause, CASE rule WHEN 'view' THEN 'look away' END AS remedy FROM {REPORTS} WHERE level = 'error' AND user_id % 10 <> 0 GROUP BY 1 UNION ALL SELECT '<no-json>', count(DISTINCT user_id), 'not classified', NULL FROM events WHERE user_id % 10 = 0 HAVING count(*) > 0")
def validator_causes(spark, sf_dir):
    """A validator's reports: errors by rule with what is known of their cause; unreadable reports count as errors."""
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("value") < 30, "error").when(F.col("value") < 60, "warning").otherwise("info")
    nested = F.collect_list(F.struct(F.col("event_type").alias("ruleId"), level.alias("level"), F.lit("m").alias("message")))
    text = F.to_json(F.struct(F.lit("pass").alias("verdict"), F.col("f").alias("findings")))
    reports = e.groupBy("user_id").agg(nested.alias("f")).select(F.col("user_id").cast("string").alias("file"), F.when(F.col("user_id") % 10 == 0, "{broken").otherwise(text).alias("report"))
    known = spark.createDataFrame([("view", "seen before", "look away"), ("other", "x", "y")], "rule string, cause string, remedy string")
    return corpus.causes(corpus.findings(reports), known)


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'no index' WHEN 1 THEN 'no version' WHEN 2 THEN 'a lossy encoding without a transform record' WHEN 3 THEN 'incomplete vocabularies: IMS|units without their vocabulary' ELSE '' END AS reasons,
    s_suppkey % 5 = 4 AS injected FROM supplier""")
def index_audit(spark, sf_dir):
    """Faults of archives' indexes, and whether sample metadata was injected."""
    k = F.col("s_suppkey")
    entry = lambda i, v: F.struct(F.lit(i).alias("id"), F.lit("u").alias("uri"), F.lit(v).cast("string").alias("version"))
    vocabularies = F.when(k % 5 == 3, F.array(entry("MS", "1"), entry("IMS", None))).otherwise(F.array(entry("MS", "1"), entry("UO", "2")))
    body = F.struct(F.when(k % 5 != 1, "1.0").alias("version"), F.lit(3).alias("spectra"), F.when(k % 5 == 2, "numpress").otherwise("plain").alias("mz_encoding"), F.struct(vocabularies.alias("vocabularies"), F.when(k % 5 == 4, F.struct(F.lit("t").alias("title"))).alias("study")).alias("metadata"))
    rows = table(spark, sf_dir, "supplier").select(k.cast("string").alias("path"), F.when(k % 5 > 0, F.to_json(body)).alias("index"), F.when(k % 5 > 2, F.array(F.lit("sample_metadata/sdrf.tsv"))).alias("members"), F.array(F.lit("UO:0000031")).alias("units"))
    return archive.audit(rows).select(F.col("path").cast("long").alias("s_suppkey"), F.array_join("reasons", "|").alias("reasons"), "injected")


@query("SELECT (SELECT count(*) FROM lineitem) AS lineitem, (SELECT count(*) FROM orders) AS orders, TRUE AS some")
def row_group_rows(spark, sf_dir):
    """Row groups of Parquet files from their footers alone."""
    sums = [archive.row_groups(spark, f"{sf_dir}/{t}.parquet").agg(F.sum("rows").alias(t), F.lit(1).alias("k")) for t in ("lineitem", "orders")]
    groups = archive.oversized_row_groups(spark, f"{sf_dir}/lineitem.parquet", 1).agg((F.count(F.lit(1)) > 0).alias("some"), F.lit(1).alias("k"))
    return sums[0].join(sums[1], "k").join(groups, "k").drop("k")


@query("SELECT page_id, sha256(replace(replace(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'), '&amp;', '&'), '&times;', chr(215))) AS bare FROM pages")
def plain_texts(spark, sf_dir):
    """Text without inline tags, and with entities as their characters."""
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(cells.plain_text(F.coalesce("html", F.lit(""))), 256).alias("bare"))


@query("SELECT CASE l_linenumber WHEN 1 THEN 'done' WHEN 2 THEN 'integrity' WHEN 5 THEN 'verification' ELSE CAST(l_linenumber AS VARCHAR) END AS outcome, count(*) AS n FROM lineitem GROUP BY 1")
def exit_codes(spark, sf_dir):
    """How often each outcome came."""
    return folds.exit_tally(table(spark, sf_dir, "lineitem"), "l_linenumber", {1: "done", 2: "integrity", 5: "verification"})


@query("""SELECT o_orderkey, 'C126' AS channel, coalesce(v[1], 0) AS intensity FROM (SELECT o_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS v FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    UNION ALL SELECT o_orderkey, 'C128', coalesce(v[2], 0) FROM (SELECT o_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS v FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)""")
def reporter_passthrough(spark, sf_dir):
    """A spectrum's own reporter array, keyed by the channels whose ion is known."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))), lambda s: s["l_quantity"]).alias("v"))
    o = table(spark, sf_dir, "orders")
    rows = o.join(lines, o["o_orderkey"] == lines["l_orderkey"], "left").select("o_orderkey", F.coalesce("v", F.array().cast("array<double>")).alias("v"))
    found = lookup.passthrough_reporters(F.col("v"), [("C126", 126.1), ("C127", None), ("C128", 128.1)])
    return rows.select("o_orderkey", F.explode(found).alias("p")).select("o_orderkey", "p.channel", "p.intensity")
