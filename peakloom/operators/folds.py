"""Folds over runs, tables of samples, and corpus statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakloom.operators.lookup import ranked
from peakloom.operators.signal import finite
from peakloom.session import materialize

# Upper bounds of the size classes of a corpus, in MB.
HISTOGRAM_EDGES = (10, 20, 50, 100, 200, 500, 1000)
#: Least ratio of neighbouring sizes in a gap sample.
LEAST_GAP = 1.31


def run_fold(spectra: DataFrame, points: DataFrame, key: str = "spectrum") -> DataFrame:
    """One row: largest coordinates, finite m/z range of level-1 spectra, presence of levels. NaN and infinities are skipped."""
    ranges = points.filter(finite(F.col("mz"))).groupBy(key).agg(F.min("mz").alias("lo"), F.max("mz").alias("hi"))
    both = spectra.join(ranges, key, "left")
    ms1 = F.col("ms_level") == 1
    return both.agg(
        F.max("x").alias("max_x"), F.max("y").alias("max_y"),
        F.min(F.when(ms1, F.col("lo"))).alias("mz_lo"), F.max(F.when(ms1, F.col("hi"))).alias("mz_hi"),
        F.bool_or(ms1).alias("has_ms1"), F.bool_or(F.col("ms_level") >= 2).alias("has_msn"),
    )


def reconcile_grid(declared_x: Column, declared_y: Column, observed_x: Column, observed_y: Column) -> Column:
    """Struct (x, y, source): declared if it holds all that was observed, else observed, with how it came about."""
    declared, observed = declared_x.isNotNull() & declared_y.isNotNull(), observed_x.isNotNull() & observed_y.isNotNull()
    fits = (observed_x <= declared_x) & (observed_y <= declared_y)
    keep = declared & (~observed | fits)
    source = F.when(declared & ~observed, "declared_unobserved").when(declared & fits, "declared").when(declared, "observed_exceeds_declared").when(observed, "observed").otherwise("unknown")
    return F.struct(F.when(keep, declared_x).otherwise(observed_x).alias("x"), F.when(keep, declared_y).otherwise(observed_y).alias("y"), source.alias("source"))


def ms_level_or_ms1(level: Column) -> Column:
    """An absent level (0 or null) is level 1."""
    return F.when(F.coalesce(level, F.lit(0)) == 0, F.lit(1)).otherwise(level)


def facet_of(representation: Column) -> Column:
    """Where a spectrum's points are stored: profiles as data, centroids and unknown ones as peaks."""
    return F.when(representation == "profile", "spectra_data").otherwise("spectra_peaks")


def sample_table(rows: DataFrame, name: str, order: str) -> DataFrame:
    """(sample_id, name, first_row): one per distinct name, `sample-N` by where it is first seen."""
    first = rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.min(order).alias("first_row"))
    return ranked(first, ["first_row"], "__rank").select(F.concat(F.lit("sample-"), F.col("__rank").cast("string")).alias("sample_id"), F.col(name).alias("name"), "first_row")


def factor_levels(rows: DataFrame, sample: str, factors: list[str], order: str) -> DataFrame:
    """(factor, sample, value, first_row): distinct non-empty values of each factor column by sample."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.trim(F.col(f)).alias("value")) for f in factors]))
    long = rows.select(F.col(sample).alias("sample"), F.col(order).alias("__o"), pairs.alias("p")).select("sample", "__o", "p.*")
    return long.filter(F.length("value") > 0).groupBy("factor", "sample", "value").agg(F.min("__o").alias("first_row"))


def size_tiers(files: DataFrame, group: str, kind: str, size: str, kinds: list[str]) -> DataFrame:
    """(group, one sum of sizes per kind, total): conditional sums in one aggregation."""
    return files.groupBy(group).agg(*[F.sum(F.when(F.col(kind) == k, F.col(size)).otherwise(F.lit(0))).alias(f"{k}_bytes") for k in kinds], F.sum(size).alias("total_bytes"))


def mean_ratio(datasets: DataFrame, family: str, part: str, whole: str) -> DataFrame:
    """(family, datasets, mean_ratio): the mean of ratios, not the ratio of sums; datasets without a whole don't count."""
    return datasets.groupBy(family).agg(F.count(F.try_divide(part, whole)).alias("datasets"), F.avg(F.try_divide(F.col(part).cast("double"), F.col(whole))).alias("mean_ratio"))


def log_histogram(sizes: DataFrame, size: str, base: float = 2.0) -> DataFrame:
    """(bin, n, lo, hi): counts by the whole part of the size's logarithm; sizes under 1 don't count."""
    found = sizes.filter(F.col(size) >= 1)
    return found.groupBy(F.floor(F.log(F.col(size)) / math.log(base) + 1e-12).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("lo"), F.max(size).alias("hi"))


def gap_sample(sizes: DataFrame, size: str, least: float = LEAST_GAP) -> DataFrame:
    """(value): greedily from the least size, each at least `least` times the one before.

    Sequential by nature, with log(largest / least) / log(least gap) steps. The least and largest size of fine log bins,
    of which a few thousand span all sizes, come to the driver; only where a step ends within a bin is that bin asked.
    """
    spark, v = sizes.sparkSession, F.col(size).cast("double")
    distinct = materialize(sizes.filter(v > 0).select(v.alias("v")).distinct().withColumn("b", F.floor(F.log("v") / math.log(least) * 64)), "sizes")
    bins = [(r["lo"], r["hi"], r["b"]) for r in distinct.groupBy("b").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("lo").collect()]
    picked, bound = [], 0.0
    for lo, hi, b in bins:
        if hi < bound:
            continue
        value = lo if lo >= bound else distinct.filter((F.col("b") == b) & (F.col("v") >= bound)).agg(F.min("v")).first()[0]
        picked.append((float(value),))
        bound = value * least
    return spark.createDataFrame(picked, "value double")


def rule_tally(findings: DataFrame, rule: str, passed: Column) -> DataFrame:
    """(rule, n, passed, failed)."""
    return findings.groupBy(rule).agg(F.count(F.lit(1)).alias("n"), F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"))


def corpus_tiers(files: DataFrame, dataset: str, name: str, size: str, imaging: str) -> DataFrame:
    """(dataset, raw_bytes, xml_bytes, archive_bytes, input_bytes, of_raw, of_xml): sizes of each tier and the archive's percentages.

    Raw is vendor files and images, of imaging datasets sidecars and images; XML is spectra or imaging files with what
    they need. The input is raw if there is any. A percentage of nothing is `n.a.`.
    """
    from peakloom.functions.cells import file_kind

    total = lambda kind: F.sum(F.when(F.col("__k") == kind, F.col(size)).otherwise(0))
    names = ("archive", "image", "imaging", "spectra", "sidecar", "vendor")
    sums = files.withColumn("__k", file_kind(F.col(name))).groupBy(dataset).agg(F.bool_or(imaging).alias("__i"), *[total(k).alias(k) for k in names])
    raw = F.when(F.col("__i"), F.col("sidecar") + F.col("image")).otherwise(F.col("vendor") + F.col("image"))
    text = F.when(F.col("__i"), F.col("imaging") + F.col("sidecar") + F.col("image")).otherwise(F.col("spectra") + F.col("image"))
    rows = sums.select(dataset, raw.alias("raw_bytes"), text.alias("xml_bytes"), F.col("archive").alias("archive_bytes"))

    def percent(whole: str):
        some = (F.col(whole) > 0) & (F.col("archive_bytes") > 0)
        return F.when(some, F.concat(F.bround(100.0 * F.col("archive_bytes") / F.col(whole), 0).cast("long").cast("string"), F.lit("%"))).otherwise("n.a.")

    return rows.select("*", F.when(F.col("raw_bytes") > 0, F.col("raw_bytes")).otherwise(F.col("xml_bytes")).alias("input_bytes"), percent("raw_bytes").alias("of_raw"), percent("xml_bytes").alias("of_xml"))


def findings_by_rule(findings: DataFrame, rule: str, file: str) -> DataFrame:
    """(rule, n, files): findings of each rule and the distinct files that have them; order by n for a report."""
    return findings.groupBy(rule).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(file).alias("files"))


def group_totals(files: DataFrame, subset: str, dataset: str, size: str, unlisted: list[str]) -> DataFrame:
    """(subset, datasets, files, bytes) of every subset, and a row with a null subset: the totals of those that are listed."""
    named = files.withColumn("__listed", ~F.col(subset).isin(*unlisted) if unlisted else F.lit(True))
    totals = [F.countDistinct(dataset).alias("datasets"), F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes")]
    return named.groupBy(subset).agg(*totals).unionByName(named.filter("__listed").groupBy(F.lit(None).cast("string").alias(subset)).agg(*totals))


def qualifying(tiers: DataFrame, least_mb: float) -> DataFrame:
    """Of datasets' tiers (as corpus_tiers gives them) those whose input is larger than so many MB and that have an archive."""
    return tiers.filter((F.col("input_bytes") > F.lit(least_mb * 1024 * 1024)) & (F.col("archive_bytes") > 0))


def listing_order(files: DataFrame, group: str, name: str, archive: str = "archive") -> DataFrame:
    """files with `place` (from 1) in their group: archives first, then by name without case."""
    from pyspark.sql.window import Window

    low = F.lower(name)
    return files.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy((~low.endswith(f".{archive}")).cast("int"), low, name)))


def exit_tally(runs: DataFrame, code: str, meanings: dict[int, str]) -> DataFrame:
    """(outcome, n): how often each exit code came, by its meaning; an unknown code is its number."""
    named = F.coalesce(*[F.when(F.col(code) == k, F.lit(v)) for k, v in meanings.items()], F.col(code).cast("string"))
    return runs.groupBy(named.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
