"""Scalar functions over metadata cells: CURIEs, sample-table cells, labels, paths, sizes."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Cells that stand for no value, compared without case.
NOT_AVAILABLE = ("not available", "not applicable", "anonymized")
# Labels that are never isobaric, compared without case.
NOT_ISOBARIC = ("label free sample", "label-free sample", "silac light", "silac medium", "silac heavy")
# Label, accession and reporter ion (Th) of isobaric reagents.
REAGENTS = (
    ("TMT126", "MS:1002616", 126.127726), ("TMT127", "MS:1002617", 127.124761), ("TMT128", "MS:1002618", 128.128116), ("TMT129", "MS:1002619", 129.131471),
    ("TMT130", "MS:1002620", 130.134825), ("TMT131", "MS:1002621", 131.138180), ("TMT127N", "MS:1002763", 127.124761), ("TMT127C", "MS:1002764", 127.131081),
    ("TMT128N", "MS:1002765", 128.128116), ("TMT128C", "MS:1002766", 128.134436), ("TMT129N", "MS:1002767", 129.131471), ("TMT129C", "MS:1002768", 129.137790),
    ("TMT130N", "MS:1002769", 130.134825), ("TMT130C", "MS:1002770", 130.141145), ("TMT131N", "MS:1002621", 131.138180), ("TMT131C", "MS:1002621", 131.144500),
    ("iTRAQ113", "MS:1002623", 113.107873), ("iTRAQ114", "MS:1002624", 114.111228), ("iTRAQ115", "MS:1002625", 115.108263), ("iTRAQ116", "MS:1002626", 116.111618),
    ("iTRAQ117", "MS:1002627", 117.114973), ("iTRAQ118", "MS:1002628", 118.111958), ("iTRAQ119", "MS:1002629", 119.115313), ("iTRAQ121", "MS:1002630", 121.122003),
)
# Isobaric labels without an accession and a reporter ion of their own, and their parent term.
UNRESOLVED, UNRESOLVED_TERM = ("TMT132N", "TMT132C", "TMT133N", "TMT133C", "TMT134N", "TMT134C", "TMT135N"), "MS:1002615"


def curie(text: Column) -> Column:
    """Struct (prefix, accession) of text split at its first colon; null unless both are there."""
    parts = F.split(F.trim(text), ":", 2)
    ok = (F.size(parts) == 2) & (F.length(F.get(parts, F.lit(0))) > 0) & (F.length(F.get(parts, F.lit(1))) > 0)
    return F.when(ok, F.struct(F.get(parts, F.lit(0)).alias("prefix"), F.get(parts, F.lit(1)).alias("accession")))


def is_na(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(*NOT_AVAILABLE)


def cell(text: Column) -> Column:
    """Struct (value, accession, term_source, unit, is_na, extra) of a sample-table cell.

    A cell without `=` is plain and stays as it is. Else its `;` parts are key=value, split at the first `=`: NT names
    the value (else the first part without `=` does), AC the accession, TS the source, UO or UNIT the unit. Accessions
    and units that aren't CURIEs, and all other parts, stay in extra, in order and with repeats. Of repeated keys the
    last counts; keys are compared with case.
    """
    tokens = F.filter(F.transform(F.split(text, ";"), lambda t: F.trim(t)), lambda t: t != "")
    keyed = lambda t: F.contains(t, F.lit("="))
    pair = lambda t: F.when(keyed(t), F.struct(F.trim(F.substring_index(t, "=", 1)).alias("k"), F.trim(F.regexp_replace(t, "^[^=]*=", "")).alias("v"))).otherwise(F.struct(F.lit("_bare").alias("k"), t.alias("v")))
    pairs = F.transform(tokens, pair)
    is_unit = lambda p: p["k"].isin("UO", "UNIT") & curie(p["v"]).isNotNull()

    def last(keep) -> Column:
        return F.try_element_at(F.filter(pairs, keep), F.lit(-1))["v"]

    structured = keyed(text)
    bare = F.filter(tokens, lambda t: ~keyed(t))
    first_bare = F.array_position(F.transform(tokens, lambda t: ~keyed(t)), True) - 1
    accession = last(lambda p: p["k"] == "AC")
    rest = F.filter(pairs, lambda p, i: ~p["k"].isin("NT", "AC", "TS") & ~is_unit(p) & (i != first_bare))
    odd = F.filter(F.array(F.struct(F.lit("AC").alias("k"), accession.alias("v"))), lambda p: p["v"].isNotNull() & curie(p["v"]).isNull())
    value = F.when(structured, F.coalesce(last(lambda p: p["k"] == "NT"), F.get(bare, F.lit(0)), F.lit(""))).otherwise(text)
    return F.struct(
        value.alias("value"),
        F.when(structured & curie(accession).isNotNull(), accession).alias("accession"),
        F.when(structured, last(lambda p: p["k"] == "TS")).alias("term_source"),
        F.when(structured, last(is_unit)).alias("unit"),
        is_na(value).alias("is_na"),
        F.when(structured, F.concat(odd, rest)).alias("extra"),
    )


def is_isobaric(label: Column) -> Column:
    """Whether the trimmed label is an isobaric reagent's, with case."""
    return ~F.lower(F.trim(label)).isin(*NOT_ISOBARIC) & F.trim(label).isin(*[r[0] for r in REAGENTS], *UNRESOLVED)


def channel_role(is_carrier: Column, is_reference: Column, is_pooled: Column) -> Column:
    """carrier before reference before pooled before sample."""
    return F.when(is_carrier, "carrier").when(is_reference, "reference").when(is_pooled, "pooled").otherwise("sample")


def inflected(cv: Column, accession: Column, name: Column) -> Column:
    """Column name of a controlled term: CV, accession and cleaned name."""
    cleaned = F.regexp_replace(F.regexp_replace(name, "m/z", "mz"), r"[^a-zA-Z0-9_\-]+", "_")
    return F.concat_ws("_", cv, accession, cleaned)


def normal_uuid(text: Column) -> Column:
    """32 lower-case hex digits of a UUID however it is written; null if there aren't as many."""
    digits = F.lower(F.regexp_replace(text, "[^0-9A-Fa-f]", ""))
    return F.when(F.length(digits) == 32, digits)


def safe_location(location: Column) -> Column:
    """relative, absolute or rejected (a `..` step), for a location with or without a file scheme."""
    path = F.regexp_replace(location, r"^file://[^/]*", "")
    return F.when(F.exists(F.split(path, r"[/\\]"), lambda c: c == ".."), "rejected").when(path.startswith("/"), "absolute").otherwise("relative")


def full_extent_affine(nx: Column, ny: Column, width: Column, height: Column) -> Column:
    """[a, 0, 1, 0, e, 1]: maps image pixels to grid pixels; the scale is 0 for an image one pixel wide or high."""
    scale = lambda n, w: F.when(w > 1, (n - 1) / (w - 1)).otherwise(F.lit(0.0))
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.array(scale(nx, width), zero, one, zero, scale(ny, height), one)


# Extensions of images, vendor files and metadata.
IMAGE_EXT, VENDOR_EXT = ("tif", "tiff", "png", "jpg", "jpeg", "svs", "bmp"), ("raw", "wiff", "wiff.scan", "wiff2", "tdf", "tdf_bin", "baf", "yep", "uimf")
META_EXT = ("md", "csv", "xml", "xlsx", "txt", "json", "orig-published-checksum", "tsv")


def file_kind(name: Column, archive: str = "archive") -> Column:
    """archive (by its extension), image, imaging, spectra, sidecar (or no extension), vendor (or in a vendor's folder), meta or other."""
    low = F.lower(name)
    ends = lambda exts: low.rlike("[.](" + "|".join(e.replace(".", "[.]") for e in exts) + ")$")
    return (
        F.when(ends((archive,)), "archive").when(ends(IMAGE_EXT), "image").when(ends(("imzml",)), "imaging").when(ends(("mzml",)), "spectra")
        .when(ends(("ibd",)), "sidecar").when(ends(VENDOR_EXT) | low.rlike("[.](d|raw)/"), "vendor").when(ends(META_EXT), "meta")
        .when(~F.contains(F.substring_index(low, "/", -1), F.lit(".")), "sidecar").otherwise("other")
    )


def human_size(size: Column) -> Column:
    """Whole bytes with a unit of powers of 1024; one decimal from KB on, of a tie the even one."""
    n = size.cast("long")

    def for_unit(k: int, unit: str) -> Column:
        tenths = F.shiftright(n * 10, 10 * k)
        twice = (n * 10 - tenths * 1024**k) * 2
        shown = tenths + F.when((twice > 1024**k) | ((twice == 1024**k) & (tenths % 2 == 1)), 1).otherwise(0)
        return F.when(n >= 1024**k, F.concat(F.floor(shown / 10).cast("string"), F.lit("."), (shown % 10).cast("string"), F.lit(unit)))

    return F.coalesce(*[for_unit(k, u) for k, u in ((4, " TB"), (3, " GB"), (2, " MB"), (1, " KB"))], F.concat(n.cast("string"), F.lit(" B")))


def plain_text(text: Column) -> Column:
    """text without inline tags, with the entities for ampersand and multiplication sign as characters."""
    bare = F.regexp_replace(text, "<[^>]+>", "")
    return F.replace(F.replace(bare, F.lit("&amp;"), F.lit("&")), F.lit("&times;"), F.lit("\u00d7"))


# Tag of a file by how its name ends, in order.
FILE_TAGS = (
    (".imzml", "imzml"), (".ibd", "ibd"), (".mzml", "mzml"), (".raw", "raw"), (".d", "raw"), (".wiff", "raw"), (".sdrf.tsv", "sdrf"), (".tsv", "sdrf"),
    (".txt", "isa"), (".tif", "img"), (".tiff", "img"), (".png", "img"), (".jpg", "img"), (".svs", "img"),
)


def file_tag(name: Column, archive: str = "archive") -> Column:
    """A file's tag: by its ending, else up to six characters of its extension, else `file`."""
    low = F.lower(name)
    known = [F.when(low.endswith(end), F.lit(tag)) for end, tag in ((f".{archive}", archive), *FILE_TAGS)]
    rest = F.when(F.contains(name, F.lit(".")), F.substring(F.substring_index(name, ".", -1), 1, 6)).otherwise("file")
    return F.coalesce(*known, rest)


def register(spark: SparkSession) -> None:
    """Make the point and cell functions available to SQL: functions over built-ins, and Arrow functions for the codec."""
    functions = {
        "tic(a ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(a, 0D, (s, x) -> s + x)",
        "curie_prefix(s STRING) RETURNS STRING": "nullif(substring_index(trim(s), ':', 1), trim(s))",
        "curie_accession(s STRING) RETURNS STRING": "nullif(get(split(trim(s), ':', 2), 1), '')",
        "file_stem(p STRING) RETURNS STRING": "regexp_replace(substring_index(replace(p, chr(92), '/'), '/', -1), '[.][^.]*$', '')",
        "zero_run_mask(mz ARRAY<DOUBLE>, v ARRAY<DOUBLE>) RETURNS ARRAY<STRUCT<mz: DOUBLE, intensity: DOUBLE>>":
            "filter(transform(mz, (m, i) -> named_struct('mz', m, 'intensity', get(v, i))), (p, i) -> p.intensity <> 0 or coalesce(get(v, i - 1), 0) <> 0 or coalesce(get(v, i + 1), 0) <> 0)",
        "nearest_intensity(mz ARRAY<DOUBLE>, v ARRAY<DOUBLE>, target DOUBLE, tolerance DOUBLE) RETURNS DOUBLE":
            "aggregate(filter(transform(mz, (m, i) -> named_struct('d', abs(m - target), 'v', get(v, i))), p -> p.d <= tolerance), named_struct('d', double('inf'), 'v', 0D), (b, p) -> if(p.d < b.d, p, b)).v",
    }
    # table functions, for lateral joins: a spectrum's points, and the parts of a sample-table cell
    functions |= {
        "points(mz ARRAY<DOUBLE>, v ARRAY<DOUBLE>) RETURNS TABLE(place INT, mz DOUBLE, intensity DOUBLE)":
            "SELECT p.pos, p.mz_, get(points.v, p.pos) FROM posexplode(points.mz) AS p(pos, mz_)",
        "sdrf_tokens(cell STRING) RETURNS TABLE(place INT, name STRING, value STRING)":
            "SELECT t.pos, if(contains(t.token, '='), trim(substring_index(t.token, '=', 1)), NULL), if(contains(t.token, '='), trim(regexp_replace(t.token, '^[^=]*=', '')), t.token)"
            " FROM posexplode(filter(transform(split(sdrf_tokens.cell, ';'), x -> trim(x)), x -> x <> '')) AS t(pos, token)",
    }
    for head, body in functions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    from peakloom.functions import numpress

    spark.udf.register("numpress_encode", numpress.encode_udf())
    spark.udf.register("numpress_decode", numpress.decode_udf())
