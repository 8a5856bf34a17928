"""The archive: Parquet facets in a folder, and an index that is written last."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from peakloom.functions.numpress import decode_linear, encode_linear
from peakloom.operators import arrays, folds, signal
from peakloom.operators.verify import LOSSY
from peakloom.sources import buckets as buckets_
from peakloom.sources import terms, xml

FORMAT_VERSION = "1.1"
#: By name: encoding of m/z, level of compression, bytes of a row group (0: as many as the writer likes).
PRESETS = {"compact": ("numpress", 9, 24 << 20), "lossless": ("delta", 9, 24 << 20), "legacy": ("plain", 3, 0)}
PRECURSOR = f"struct<ref:string,source_file:string,external_id:string,isolation:{xml.KEPT},ions:array<{xml.KEPT}>,activation:{xml.KEPT}>"
TRACE = f"chrom_index long, id string, params {xml.KEPT}, precursor {PRECURSOR}, product {xml.KEPT}, time array<double>, intensity array<double>, others {xml.OTHERS}"
MEMBER = "name string, sha256 string, size_bytes long, content binary"
#: The record of the lossy transform; its bounds are those of verify.LOSSY.
NUMPRESS = {"transform": "MS:1002312", "name": "Numpress linear prediction m/z compression", "axis": "m/z", "conformance_level": "L2", "mz_rel_err": LOSSY.mz, "intensity_rel_err": LOSSY.intensity}
#: Columns of a pixel's place: whole numbers from 1, z may be absent.
COORDINATES = StructType([StructField("x", LongType(), False), StructField("y", LongType(), False), StructField("z", LongType(), True)])
META = ["spectrum_index", "native_id", "ms_level", "representation", *COORDINATES.names, "rt_seconds", "mz_type", "intensity_type", "precursor", "params", "combination", "scans", "precursors", "products"]
FACETS = ("spectra_data", "spectra_peaks")
#: Least spectra in a part; facets are bucketed by part, so what belongs together is read together. A long run has longer
#: parts, PARTS of them for a bucket: each task that writes adds a file to the buckets of its own parts alone.
PART, PARTS = 512, 8
#: Columns of the facets' rows beside a spectrum's own: which chunk of it they hold, and the bounds of its m/z.
CHUNK = ["place", "chunk", "chunk_start", "chunk_end"]
SORTED = ["chunk", "spectrum_index"]
#: Spectra out of order that the index names, and spectra whose intensities' width is looked at before writing.
LISTED, SAMPLED = 32, 256


def checked(spectra: DataFrame) -> DataFrame:
    """spectra whose rows fail if axes differ in length, a coordinate is below 1, or a centroid's m/z isn't finite."""
    mz, intensity = F.col("mz"), F.col("intensity")
    name = F.coalesce(F.col("native_id") if "native_id" in spectra.columns else F.lit(None), F.col("spectrum_index").cast("string"))
    size = lambda a: F.coalesce(F.size(a), F.lit(0))
    faults = [(size(mz) != size(intensity), "axes differ in length: ")]
    for c in COORDINATES.names:
        if c in spectra.columns:
            faults.append((F.coalesce(F.col(c) < 1, F.lit(False)), f"COORDINATE: {c} is below 1: "))
    if "representation" in spectra.columns:
        faults.append(((F.col("representation") == "centroid") & signal.first_non_finite(mz).isNotNull(), "an m/z isn't finite: "))
    fault = F.coalesce(*[F.when(bad, F.concat(F.lit(text), name)) for bad, text in faults])
    return spectra.withColumn("mz", F.when(fault.isNotNull(), F.raise_error(fault).cast(spectra.schema["mz"].dataType)).otherwise(mz))


def part_size(spectra: int | None, buckets: int) -> int:
    """Spectra in a part of a run that has about so many."""
    return max(PART, -(-(spectra or 0) // (PARTS * buckets)))


def layered(spectra: DataFrame, mask: bool, encoding: str, width: str, size: int = PART) -> DataFrame:
    """The rows of all facets, made in one pass by the tasks that read the spectra.

    Each spectrum gives a row of spectra_metadata and, in the facet that its representation names, one for each chunk of
    m/z (one in all where m/z is stored plain). size: spectra in a part. Arrays are in m/z order and profiles masked as arrays.canonical does.
    """
    names = [c for c in spectra.columns if c not in ("mz", "intensity", "others")]
    others = "others" in spectra.columns
    canonical = arrays.ordering(spectra.columns, mask, others)
    mz_kind = {"plain": "array<double>", "delta": "array<long>", "numpress": "binary"}[encoding]
    meta = [f"{c} {spectra.schema[c].dataType.simpleString()}" for c in names if c != "spectrum_index"]
    index = spectra.schema["spectrum_index"].dataType.simpleString()
    ddl = ", ".join([f"facet string, part long, spectrum_index {index}", *meta, "was_unsorted boolean, n_points int, place int, chunk long, chunk_start double, chunk_end double", f"mz {mz_kind}, intensity array<{width}>"] + [f"others {xml.OTHERS}"] * others)
    kind = StructType.fromDDL(ddl)
    types = [(f.name, to_arrow_type(f.dataType)) for f in kind.fields]

    def batch(n: int, have: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([have[c].cast(t) if c in have else pa.nulls(n, t) for c, t in types], names=[c for c, _ in types])

    def run(batches):
        for b in canonical(batches):
            own = dict(zip(b.schema.names, b.columns, strict=True))
            part = pc.floor(pc.divide(own["spectrum_index"].cast(pa.float64()), float(size)))
            mz, offsets, no_mz = arrays.flat(own["mz"])
            intensity, own_offsets, no_intensity = arrays.flat(own["intensity"])
            head = {c: own[c] for c in (*names, "was_unsorted")}
            yield batch(b.num_rows, head | {"facet": pa.array(["spectra_metadata"] * b.num_rows), "part": part, "n_points": pa.array(np.diff(offsets))})
            if encoding == "plain":
                row, begin, end = np.arange(b.num_rows), offsets[:-1], offsets[1:]
            else:
                row, begin, end = arrays.chunk_bounds(mz, offsets)
            some = end > begin
            low, high = np.full(len(row), np.nan), np.full(len(row), np.nan)
            if some.any():
                low[some], high[some] = np.minimum.reduceat(mz, begin[some]), np.maximum.reduceat(mz, begin[some])
            place = np.arange(len(row)) - np.searchsorted(row, row)
            gone = ~some
            found = {"spectrum_index": own["spectrum_index"].take(row), "part": part.take(row), "place": pa.array(place), "chunk_start": pa.array(low, mask=gone), "chunk_end": pa.array(high, mask=gone)}
            with np.errstate(invalid="ignore"):
                found["chunk"] = pa.array(np.where(np.isfinite(low), np.floor(np.nan_to_num(low) / arrays.CHUNK_WIDTH), -1).astype(np.int64)) if encoding != "plain" else pa.array(np.zeros(len(row), np.int64))
            if encoding == "numpress":
                found["mz"] = pa.array([None if no_mz[r] else encode_linear(mz[x:y]) for r, x, y in zip(row, begin, end, strict=True)], pa.binary())
            elif encoding == "delta":
                found["mz"] = arrays.lists(arrays.bit_deltas(mz, begin[some]), end - begin, no_mz[row], pa.int64())
            else:
                found["mz"] = own["mz"]
            found["intensity"] = arrays.lists(intensity, end - begin if encoding != "plain" else np.diff(own_offsets), no_intensity[row], pa.float64())
            if others:
                lists = own["others"].to_pylist()
                n = np.diff(offsets)
                cut = lambda r, x, y, first: lists[r] and [a for o in lists[r] if (a := arrays.piece(o, int(n[r]), int(x - offsets[r]), int(y - offsets[r]), first)) is not None]  # noqa: E731, B023
                found["others"] = own["others"] if encoding == "plain" else pa.array([cut(r, x, y, k == 0) for r, x, y, k in zip(row, begin, end, place, strict=True)], dict(types)["others"])
            data = np.array([r == "profile" for r in own["representation"].to_pylist()], bool)[row] if "representation" in own else np.zeros(len(row), bool)
            found["facet"] = pa.array(np.where(data, *FACETS))
            yield batch(len(row), found)

    return spectra.mapInArrow(run, kind)


def write_archive(
    spectra: DataFrame, path: str, mask: bool = True, metadata: dict | None = None, mz_encoding: str = "plain", chromatograms: DataFrame | None = None,
    members: DataFrame | None = None, level: int = 3, group_bytes: int = 0, intensity_width: str = "float", finish=None, n_spectra: int | None = None,
) -> dict:
    """Write spectra (arrays mz and intensity beside any of META, others and reporters) as facets under path; returns the index.

    Points are sorted by m/z; profiles lose interior zero runs where mask is on. Spectra that `checked` refuses fail.
    mz_encoding: plain, delta (differences of bit patterns, nothing is lost) or numpress (lossy); the latter two are
    stored in chunks of m/z. intensity_width: float, double, or source: double if any spectrum's intensities are, which
    is told from SAMPLED spectra and made good in a second pass where they were wrong. Spectra are read and decoded
    once, and written by the tasks that read them, without an exchange; facets are bucketed by parts of PART spectra or
    more (n_spectra: about how many there are, as far as known) and sorted by chunk, so that a window of m/z prunes row groups. Without an index the folder is no archive. finish:
    called with the metadata facet for further metadata and members, such as need the spectra's places.
    """
    spark = spectra.sparkSession
    have = [c for c in META if c in spectra.columns]
    extra = [c for c in ("reporters", "others") if c in spectra.columns]
    flag = F.col("level_absent") if "level_absent" in spectra.columns else F.lit(False)
    rows = checked(spectra.select(*have, *extra, "mz", "intensity", flag.alias("level_absent")))
    typed = "intensity_type" in have
    wide = not typed and dict(spectra.dtypes)["intensity"] == "array<double>"
    width = "double" if intensity_width == "double" or (intensity_width == "source" and wide) else "float"
    if intensity_width == "source" and typed:
        width = "double" if any(r[0] == "f64" for r in spectra.select("intensity_type").limit(SAMPLED).collect()) else "float"
    options = {"compression": "zstd", "parquet.compression.codec.zstd.level": level}
    if group_bytes:  # looked at after each row, as rows differ in size
        options |= {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 64}
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = part_size(n_spectra, buckets)
    while True:
        plan = layered(rows, mask, mz_encoding, width, size)
        buckets_.write(plan, path, buckets, "part", SORTED, "facet", options)
        layout = {"buckets": buckets, "part": size, "facets": plan.drop("facet").schema.jsonValue()}
        for facet in ("spectra_metadata", *FACETS):  # all are always there, if without a file
            make_folder(spark, f"{path}/facet={facet}")
        heads = facet_rows(spark, path, "spectra_metadata", layout)
        largest = lambda c: F.max(c).alias(f"max_{c}") if c in have else F.lit(None).cast("long").alias(f"max_{c}")
        flags = lambda c, ok: F.coalesce(F.bool_or(ok), F.lit(False)) if c in have else F.lit(False)
        counts = heads.agg(
            F.count(F.lit(1)).alias("n"), F.count_if("was_unsorted").alias("resorted"), F.count_if("level_absent").alias("remapped"), flags("intensity_type", F.expr("intensity_type = 'f64'") if typed else None).alias("wide"),
            flags("ms_level", F.expr("ms_level = 1") if "ms_level" in have else None).alias("ms1"), flags("ms_level", F.expr("ms_level > 1") if "ms_level" in have else None).alias("msn"), largest("x"), largest("y"),
        ).first()
        spans = [facet_rows(spark, path, f, layout).select("chunk_start", "chunk_end") for f in FACETS]
        span = spans[0].unionByName(spans[1]).agg(F.min(F.when(signal.finite(F.col("chunk_start")), F.col("chunk_start"))).alias("mz_lo"), F.max(F.when(signal.finite(F.col("chunk_end")), F.col("chunk_end"))).alias("mz_hi")).first().asDict()
        wide = counts["wide"] if typed else wide
        if not (intensity_width == "source" and wide and width == "float"):
            break
        width = "double"  # a wide spectrum came after those that were sampled
        delete(spark, path)

    metadata = dict(metadata or {})
    if finish:
        more, members = finish(heads)
        metadata |= more
    # nothing is made up for a run without traces
    traces = StructType.fromDDL(TRACE)
    given = spark.createDataFrame([], traces) if chromatograms is None else chromatograms.select(*[F.col(f.name) if f.name in chromatograms.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in traces.fields])
    given.write.options(compression="zstd", **{"parquet.compression.codec.zstd.level": level}).parquet(f"{path}/facet=chromatograms")
    (spark.createDataFrame([], MEMBER) if members is None else members.select("name", "sha256", "size_bytes", "content")).write.parquet(f"{path}/facet=members")

    narrowed = width == "float" and wide
    warnings = []
    if counts["remapped"]:
        warnings.append({"kind": "MS level absent, taken as 1", "n": counts["remapped"]})
    if counts["resorted"]:
        first = [r[0] for r in heads.filter("was_unsorted").select("spectrum_index").orderBy("spectrum_index").limit(LISTED).collect()]
        warnings.append({"kind": "m/z not ascending, sorted", "n": counts["resorted"], "first": first})
    if mz_encoding == "numpress":
        metadata["transform"] = NUMPRESS
    done = [("sorted by m/z", counts["resorted"] > 0), ("zero runs masked", mask), ("m/z coded with loss", mz_encoding == "numpress"), ("intensities narrowed to 32 bits", narrowed)]
    index = {
        "version": FORMAT_VERSION, "spectra": counts["n"], "resorted": counts["resorted"], "mz_encoding": mz_encoding, "masked": mask, "intensity_width": width, "narrowed": narrowed, "layout": layout,
        "fold": {"max_x": counts["max_x"], "max_y": counts["max_y"]} | span,
        "content": [t for t, some in (("ms1", counts["ms1"]), ("msn", counts["msn"])) if some], "warnings": warnings, "processing": [s for s, ok in done if ok], "metadata": metadata,
    }
    index["metadata"]["content"] = content_terms(index)
    spark.createDataFrame([(json.dumps(index),)], "value string").coalesce(1).write.text(f"{path}/index")
    return index


# Accessions that say what kind of content a description is of.
CONTENT = ("MS:1000294", "MS:1000322", "MS:1000325", "MS:1000326", "MS:1000341", "MS:1000579", "MS:1000580", "MS:1000581", "MS:1000582", "MS:1000583", "MS:1000804", "MS:1000805", "MS:1000806")


def content_terms(index: dict) -> list[dict]:
    """What kinds of spectra an archive has: as the source says, else from the levels that were seen; mass spectra if none was."""
    out: list[dict] = list(index["metadata"].get("content") or [])
    if any(p["accession"] in CONTENT for p in out):
        return out
    seen = [{"accession": a, "name": n} for level, a, n in (("ms1", terms.MS1_SPECTRUM, "MS1 spectrum"), ("msn", terms.MSN_SPECTRUM, "MSn spectrum")) if level in index["content"]]
    return out + (seen or ([{"accession": terms.MASS_SPECTRUM, "name": "mass spectrum"}] if index["spectra"] else []))


def coded(part: DataFrame, encode: bool) -> DataFrame:
    """part with m/z as Numpress bytes, or back as doubles."""
    at, names = part.columns.index("mz"), part.columns
    kind = "binary" if encode else "array<double>"

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            if encode:
                values, offsets, gone = arrays.flat(cols[at])
                cols[at] = pa.array([None if g else encode_linear(values[x:y]) for g, x, y in zip(gone, offsets, offsets[1:], strict=False)], pa.binary())
            else:
                cols[at] = decoded_lists(cols[at], "numpress")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return part.mapInArrow(run, ", ".join(f"{c} {kind if c == 'mz' else t}" for c, t in part.dtypes))


def decoded_lists(stored: pa.Array, encoding: str) -> pa.Array:
    """m/z as lists of doubles from what a facet stores."""
    if encoding == "numpress":
        found = [None if v is None else decode_linear(v) for v in stored.to_pylist()]
        return arrays.lists(np.concatenate([x for x in found if x is not None] or [np.zeros(0)]), np.array([0 if x is None else len(x) for x in found], np.int64), np.array([x is None for x in found], bool), pa.float64())
    gone = stored.is_null().to_numpy(zero_copy_only=False)
    sizes = np.where(gone, 0, stored.value_lengths().fill_null(0).to_numpy())
    deltas = stored.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return arrays.lists(arrays.from_bit_deltas(deltas, np.r_[0, np.cumsum(sizes)]), sizes, gone, pa.float64())


def decoder(encoding: str, chunks: bool = False):
    """decoded_lists as a column function, which leaves rows where they are. chunks: of lists of what is stored, joined to one list."""

    @F.arrow_udf("array<double>")
    def decode(stored: pa.Array) -> pa.Array:
        return decoded_lists(stored, encoding)

    @F.arrow_udf("array<double>")
    def decode_chunks(stored: pa.Array) -> pa.Array:
        counts = stored.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        flat = stored.flatten()
        found = decoded_lists(flat, encoding)
        first = np.cumsum(counts) - counts
        absent = flat.is_null().to_numpy(zero_copy_only=False)
        gone = counts == 0
        gone[~gone] = absent[first[~gone]]  # a spectrum without arrays has one entry, which is null
        ends = np.r_[0, np.cumsum(found.value_lengths().fill_null(0).to_numpy())]
        return arrays.lists(found.flatten().to_numpy(), ends[first + counts] - ends[first], gone, pa.float64())

    return decode_chunks if chunks else decode


def make_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def facet_rows(spark: SparkSession, path: str, facet: str, layout: dict) -> DataFrame:
    """A facet's rows, bucketed by part."""
    schema = StructType.fromJson(layout["facets"])
    arrays_ = ("mz", "intensity", "others", *CHUNK)
    wanted = [f for f in schema.fields if (f.name not in arrays_ if facet == "spectra_metadata" else f.name in ("part", "spectrum_index", *arrays_))]
    sort = [c for c in SORTED if c in {f.name for f in wanted}]
    return buckets_.read(spark, f"{path}/facet={facet}", StructType(wanted), layout["buckets"], "part", sort)


def read_index(spark: SparkSession, path: str) -> dict:
    """The index of an archive; a folder without one fails."""
    return json.loads(spark.read.text(f"{path}/index").first()["value"])


def read_archive(spark: SparkSession, path: str, representation: str | None = None, parts: bool = False) -> DataFrame:
    """Metadata and arrays of an archive's spectra; filters on spectrum_index reach the facets' scans.

    Arrays come from the facet that a spectrum's representation names; one representation reads one facet only. Facets
    are bucketed alike, so chunks meet one another and their metadata without an exchange. parts: with the column `part`.
    """
    index = read_index(spark, path)
    layout, encoding = index["layout"], index["mz_encoding"]
    meta = facet_rows(spark, path, "spectra_metadata", layout).drop("was_unsorted", "level_absent")
    both = None
    for facet in FACETS:
        if representation and (facet == "spectra_data") != (representation == "profile"):
            continue
        found = whole_spectra(facet_rows(spark, path, facet, layout), encoding)
        own = meta.filter(folds.facet_of(F.col("representation")) == facet) if "representation" in meta.columns else meta.filter(F.lit(facet == "spectra_peaks"))
        one = (own.filter(F.col("representation") == representation) if representation else own).join(found.hint("merge"), ["part", "spectrum_index"], "left")
        both = one if both is None else both.unionByName(one)
    if encoding != "plain":  # when all are joined, as Python on the way would hide how facets are bucketed
        both = both.withColumn("mz", decoder(encoding, chunks=True)("mz"))
    # whoever joins by part asks the column how many spectra it has
    return both.withMetadata("part", {"spectra": layout.get("part", PART)}) if parts else both.drop("part")


def whole_spectra(rows: DataFrame, encoding: str) -> DataFrame:
    """(part, spectrum_index, mz, intensity, others) of a facet's rows: chunks are put together in order, those of a coded m/z as a list."""
    more = [c for c in ("others",) if c in rows.columns]
    if encoding == "plain":
        return rows.select("part", "spectrum_index", "mz", "intensity", *more)
    chunks = rows.groupBy("part", "spectrum_index").agg(F.array_sort(F.collect_list(F.struct("place", "mz", "intensity", *more))).alias("c"))
    joined = lambda name: F.flatten(F.transform("c", lambda c: c[name])).alias(name)
    # pieces of further arrays follow one another chunk by chunk
    names = F.transform(F.get("c", F.lit(0))["others"], lambda o: o) if more else None
    pieces = lambda o, k, field: F.when(o[field].isNotNull(), F.flatten(F.transform(F.filter(F.transform("c", lambda c: F.get(c["others"], k)[field]), lambda v: v.isNotNull()), lambda v: v)))
    others = [F.transform(names, lambda o, k: F.struct(o["accession"].alias("accession"), o["name"].alias("name"), o["unit"].alias("unit"), o["type"].alias("type"), pieces(o, k, "values").alias("values"), pieces(o, k, "integers").alias("integers"))).alias("others")] if more else []
    return chunks.select("part", "spectrum_index", F.col("c.mz").alias("mz"), joined("intensity"), *others)


def window_rows(spark: SparkSession, path: str, low: float, high: float) -> DataFrame:
    """(spectrum_index, mz, intensity) of the stored chunks that meet [low, high] of m/z: row groups are pruned by the chunks' bounds, and only those that stay are decoded."""
    index = read_index(spark, path)
    found = None
    for facet in FACETS:
        met = facet_rows(spark, path, facet, index["layout"]).filter((F.col("chunk_end") >= low) & (F.col("chunk_start") <= high))
        mz = F.col("mz") if index["mz_encoding"] == "plain" else decoder(index["mz_encoding"])("mz")
        one = met.select("part", "spectrum_index", mz.alias("mz"), "intensity")
        found = one if found is None else found.unionByName(one)
    return found


def window_image(spark: SparkSession, path: str, low: float, high: float) -> DataFrame:
    """(y, x, tic, present) of an imaging archive's pixels: the sum of intensities in [low, high] of m/z."""
    meta = facet_rows(spark, path, "spectra_metadata", read_index(spark, path)["layout"]).select("part", "spectrum_index", "x", "y")
    inside = F.filter(F.arrays_zip("mz", "intensity"), lambda p: p["mz"].between(low, high))
    sums = window_rows(spark, path, low, high).select("part", "spectrum_index", inside.alias("p")).filter(F.size("p") > 0)
    sums = sums.groupBy("part", "spectrum_index").agg(F.sum(signal.tic(F.col("p.intensity"))).alias("tic"))
    return meta.join(sums, ["part", "spectrum_index"], "left").select("y", "x", F.coalesce("tic", F.lit(0.0)).alias("tic"), F.col("tic").isNotNull().alias("present"))


def pixels(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """read_archive for imaging: an archive whose first spectrum has no place isn't imaging, one with a later gap is damaged."""
    spectra = read_archive(spark, path, parts=parts)
    missing = None
    if "x" in spectra.columns and "y" in spectra.columns:
        gaps = facet_rows(spark, path, "spectra_metadata", read_index(spark, path)["layout"]).filter("x is null or y is null")
        missing = gaps.agg(F.min("spectrum_index")).first()[0]
    if "x" not in spectra.columns or "y" not in spectra.columns or missing == 0:
        raise ValueError("NOT IMAGING: the archive's spectra have no coordinates")
    if missing is not None:
        raise ValueError(f"COORDINATE: spectrum {missing} has no coordinates")
    return spectra


def member_rows(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Files to keep as they are in an archive, from a map of member names to paths, with digests and sizes."""
    out = spark.createDataFrame([], MEMBER)
    for name, path in files.items():
        one = spark.read.format("binaryFile").load(path)
        out = out.unionByName(digested(one.select(F.lit(name).alias("name"), "content"), "content").select("name", "sha256", "size_bytes", "content"))
    return out


def digested(rows: DataFrame, content: str) -> DataFrame:
    """rows with sha256 and size_bytes of a column."""
    return rows.withColumns({"sha256": F.sha2(F.col(content).cast("binary"), 256), "size_bytes": F.octet_length(content).cast("long")})


def distinct_content(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(sha256, first_id, copies, bytes) of equal contents, by digest."""
    return digested(rows, content).groupBy("sha256").agg(F.min(key).alias("first_id"), F.count(F.lit(1)).alias("copies"), F.sum("size_bytes").alias("bytes"))


def extract_member(spark: SparkSession, path: str, name: str) -> bytes:
    """A kept file, byte for byte; a name without folders finds the one member that ends in it."""
    rows = spark.read.parquet(f"{path}/facet=members")
    exact = F.col("name") == name
    found = rows.filter(exact | F.col("name").endswith(f"/{name}")).orderBy(exact.desc(), "name").select("content").limit(1).collect()
    if not found:
        raise FileNotFoundError(f"{path} has no member {name}")
    return bytes(found[0]["content"])


#: What an index is read as when archives are audited.
INDEX = "version string, spectra long, mz_encoding string, metadata struct<study:string,transform:string,vocabularies:array<struct<id:string,uri:string,version:string>>>"


def audit(indexes: DataFrame) -> DataFrame:
    """(path, reasons, injected) from (path, index, members, units): faults of each archive's index, none for a sound one.

    index is its JSON text (null where there is none), members the names of kept files, units those of its columns.
    injected: whether sample metadata is kept as a member and the index has a study.
    """
    i = F.from_json("index", INDEX)
    rows = indexes.select("path", "members", "units", F.col("index").isNotNull().alias("given"), i.alias("i"))
    vocabularies = F.coalesce("i.metadata.vocabularies", F.array().cast("array<struct<id:string,uri:string,version:string>>"))
    incomplete = F.filter(vocabularies, lambda v: F.coalesce(v["id"], F.lit("")).isin("") | F.coalesce(v["uri"], F.lit("")).isin("") | F.coalesce(v["version"], F.lit("")).isin(""))
    missing_uo = F.exists(F.coalesce("units", F.array().cast("array<string>")), lambda u: u.startswith("UO:")) & ~F.exists(vocabularies, lambda v: v["id"] == "UO")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    faults = [
        (~F.col("given") | F.col("i").isNull(), F.lit("no index")),
        (F.col("given") & blank(F.col("i.version")), F.lit("no version")),
        (F.col("given") & F.col("i.spectra").isNull(), F.lit("no spectra count")),
        ((F.col("i.mz_encoding") == "numpress") & F.col("i.metadata.transform").isNull(), F.lit("a lossy encoding without a transform record")),
        (F.col("given") & (F.size(vocabularies) == 0), F.lit("no vocabularies")),
        (F.size(incomplete) > 0, F.concat(F.lit("incomplete vocabularies: "), F.array_join(F.transform(incomplete, lambda v: F.coalesce(v["id"], F.lit("?"))), ", "))),
        (F.col("given") & missing_uo, F.lit("units without their vocabulary")),
    ]
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), text) for bad, text in faults]))
    kept = F.exists(F.coalesce("members", F.array().cast("array<string>")), lambda m: m.startswith("sample_metadata/"))
    return rows.select("path", reasons.alias("reasons"), F.coalesce(kept & F.col("i.metadata.study").isNotNull(), F.lit(False)).alias("injected"))


def conformance(spark: SparkSession, paths: list[str]) -> DataFrame:
    """audit of archives: all indexes and member lists are read in one job each."""
    at = spark.createDataFrame([(p,) for p in paths], "path string")
    texts = spark.read.text([f"{p}/index" for p in paths if exists(spark, f"{p}/index")]) if any(exists(spark, f"{p}/index") for p in paths) else None
    norm = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/*", "/"), "/+$", "")
    keyed = at.withColumn("__p", norm(F.col("path")))
    if texts is None:
        return audit(keyed.select("path", F.lit(None).cast("string").alias("index"), F.array().cast("array<string>").alias("members"), F.array().cast("array<string>").alias("units")))
    texts = texts.select(norm(F.regexp_replace(F.input_file_name(), "/index/[^/]*$", "")).alias("__p"), F.col("value").alias("index"))
    have = [f"{p}/facet=members" for p in paths if exists(spark, f"{p}/facet=members")]
    kept = spark.read.option("recursiveFileLookup", True).schema(MEMBER).parquet(*have) if have else spark.createDataFrame([], MEMBER)
    kept = kept.select(norm(F.regexp_replace(F.input_file_name(), "/facet=members/[^/]*$", "")).alias("__p"), "name").groupBy("__p").agg(F.collect_set("name").alias("members"))
    both = keyed.join(texts, "__p", "left").join(kept, "__p", "left")
    # retention times are stored in seconds, a UO unit
    units = F.when(F.col("index").isNotNull(), F.array(F.lit("UO:0000010")))
    return audit(both.select("path", "index", "members", units.alias("units")))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_group, rows, bytes) of the row groups of all Parquet files under path; only footers are read."""
    import pyarrow as pa

    def run(batches):
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for b in batches:
            for file in b.column(0).to_pylist():
                store, inner = pafs.FileSystem.from_uri(file if "://" in file or file.startswith("/") else f"file:///{file.removeprefix('file:').lstrip('/')}")
                with store.open_input_file(inner) as f:
                    meta = pq.ParquetFile(f).metadata
                    groups = [meta.row_group(k) for k in range(meta.num_row_groups)]
                cols = [[file] * len(groups), list(range(len(groups))), [g.num_rows for g in groups], [g.total_byte_size for g in groups]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["path", "row_group", "rows", "bytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    return files.select("path").mapInArrow(run, "path string, row_group long, rows long, bytes long")


def oversized_row_groups(spark: SparkSession, path: str, limit: int = 64 << 20) -> DataFrame:
    """(path, row_group, rows, bytes) of the row groups that are larger than limit."""
    return row_groups(spark, path).filter(F.col("bytes") > limit)


def read_chromatograms(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACE).parquet(f"{path}/facet=chromatograms")


def both_axes(x: Column, y: Column) -> Column:
    """Struct (x, y), null unless both are there."""
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def imaging_block(geometry: DataFrame) -> DataFrame:
    """One row (grid, pixel_size, extent, offset, and the presence terms) from read_geometry's: a pair of axes or nothing."""
    pairs = [both_axes(F.col(f"{a}_x"), F.col(f"{a}_y")).alias(n) for a, n in (("grid", "declared_grid"), ("pixel", "pixel_size"), ("extent", "extent"), ("offset", "offset"))]
    return geometry.select(*pairs, "linescan_sequence", "scan_pattern", "scan_type", "line_scan_direction")
