"""Pairing, nearest peaks, ordered distinct and other keyed lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakloom.session import materialize

#: Half width of the window in which a reporter ion is looked for, in Th.
REPORTER_TOLERANCE = 0.01


def ranked(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """df with `name`: each row's place in the order, counted from start.

    Rows are sorted in ranges; only the ranges' sizes meet in one task.
    """
    ranges = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    placed = offsets_in_parts(ranges.withColumn("__one", F.lit(1)), "__part", order, "__one", start)
    return placed.withColumn(name, F.col("offset").cast("long")).drop("offset", "__one", "__part")


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, first_seen, rank): each value once, ranked from 1 by where it is first seen."""
    first = df.groupBy(value).agg(F.min(order).alias("first_seen"))
    return ranked(first, ["first_seen", value], "rank")


def pair(source: DataFrame, output: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer pairing on null-safe keys: the keys with in_source and in_output."""
    s = source.select(*keys).withColumn("__s", F.lit(True))
    o = output.select(*[F.col(k).alias(f"__{k}") for k in keys]).withColumn("__o", F.lit(True))
    on = F.lit(True)
    for k in keys:
        on = on & s[k].eqNullSafe(o[f"__{k}"])
    both = s.join(o, on, "full_outer")
    return both.select(*[F.coalesce(k, f"__{k}").alias(k) for k in keys], F.col("__s").isNotNull().alias("in_source"), F.col("__o").isNotNull().alias("in_output"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def nearest_value(mz: Column, values: Column, target: Column, tolerance: float = REPORTER_TOLERANCE) -> Column:
    """The value at the m/z nearest to target within the tolerance, the first one of a tie; 0 where there is none."""
    zipped = F.arrays_zip(mz.alias("m"), values.alias("v"))
    near = F.filter(zipped, lambda p: F.abs(p["m"] - target) <= tolerance)
    best = F.aggregate(
        near,
        F.struct(F.lit(float("inf")).alias("d"), F.lit(0.0).alias("v")),
        lambda b, p: F.when(F.abs(p["m"] - target) < b["d"], F.struct(F.abs(p["m"] - target).alias("d"), p["v"].cast("double").alias("v"))).otherwise(b),
    )
    return best["v"]


def reporters(mz: Column, values: Column, channels: list[tuple[str, float]], tolerance: float = REPORTER_TOLERANCE) -> Column:
    """Array of (channel, intensity) in the channels' order; a run has a few dozen channels. Channels have a known target."""
    return F.array(*[F.struct(F.lit(name).alias("channel"), F.coalesce(nearest_value(mz, values, F.lit(target), tolerance), F.lit(0.0)).alias("intensity")) for name, target in channels])


#: Channels that a run can have; more are refused, as each is a column of one aggregation.
MOST_CHANNELS = 200


def nearest_points(points: DataFrame, channels: DataFrame, key: str, mz: str, intensity: str, tolerance: float) -> DataFrame:
    """(key, channel, intensity): for each spectrum and channel the intensity nearest to the channel's target, else 0.

    channels has (channel, target), of at most MOST_CHANNELS rows; those without a target are left out. All channels
    are found in one aggregation over the points. Of a tie the smaller m/z stands.
    """
    wanted = channels.filter("target is not null").orderBy("channel").select("channel", "target").limit(MOST_CHANNELS + 1).collect()
    if len(wanted) > MOST_CHANNELS:
        raise ValueError(f"more than {MOST_CHANNELS} channels")

    def found(target: float):
        apart = F.abs(F.col(mz) - F.lit(target))
        near = apart <= tolerance
        return F.coalesce(F.min_by(F.when(near, F.col(intensity)), F.when(near, F.struct(apart, F.col(mz)))), F.lit(0.0))

    sums = points.groupBy(key).agg(*[found(c["target"]).alias(f"c{k}") for k, c in enumerate(wanted)], F.lit(1).alias("__any"))
    pairs = F.array(*[F.struct(F.lit(c["channel"]).alias("channel"), F.col(f"c{k}").alias("intensity")) for k, c in enumerate(wanted)])
    return sums.select(key, F.explode(pairs).alias("p")).select(key, "p.channel", "p.intensity")


def passthrough_reporters(values: Column, channels: list[tuple[str, float | None]]) -> Column:
    """Array of (channel, intensity) from a spectrum's own reporter array, which has a value for each channel with a known
    reporter ion, in their order; missing values are 0, channels without an ion have no row."""
    known = [name for name, target in channels if target is not None]
    return F.array(*[F.struct(F.lit(name).alias("channel"), F.coalesce(F.get(values, F.lit(k)), F.lit(0.0)).alias("intensity")) for k, name in enumerate(known)])


def lookahead(rows: DataFrame, key: list[str], order: str, value: str, steps: int) -> DataFrame:
    """rows with next1, next2, ...: the values that follow in each group."""
    w = Window.partitionBy(*key).orderBy(order)
    return rows.withColumns({f"next{k}": F.lead(value, k).over(w) for k in range(1, steps + 1)})


def stem(path: Column) -> Column:
    """The file's name without folders (either slash) and without its last extension."""
    return F.regexp_replace(F.substring_index(F.regexp_replace(path, r"\\", "/"), "/", -1), r"\.[^.]*$", "")


def match_runs(runs: DataFrame, rows: DataFrame, run: str, file: str) -> DataFrame:
    """(run, matches, diagnostic): metadata rows whose file has the run's stem. Case counts."""
    left = runs.select(run).withColumn("__stem", stem(F.col(run)))
    right = rows.select(stem(F.col(file)).alias("__stem"))
    counted = right.groupBy("__stem").agg(F.count(F.lit(1)).alias("matches"))
    found = left.join(counted, "__stem", "left").withColumn("matches", F.coalesce("matches", F.lit(0)).cast("long"))
    diagnostic = F.when(F.col("matches") == 0, "no row").when(F.col("matches") > 1, "several rows").otherwise("one row")
    return found.select(run, "matches", diagnostic.alias("diagnostic"))


def first_match(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value): of each key the value of its first row in document order."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def resolve(refs: DataFrame, ref: str, tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Resolve a reference in the first table that has it, else to itself: adds resolved and diagnostic.

    tables: (DataFrame, key column, value column) in order of precedence; keys are unique.
    """
    out, hits = refs, []
    for k, (t, key, value) in enumerate(tables):
        out = out.join(t.select(F.col(key).alias(f"__k{k}"), F.col(value).alias(f"__v{k}")), F.col(ref) == F.col(f"__k{k}"), "left")
        hits.append(F.col(f"__v{k}"))
    out = out.withColumns({"resolved": F.coalesce(*hits, F.col(ref).cast("string")), "diagnostic": F.when(F.coalesce(*hits).isNull(), F.lit("unresolved"))})
    return out.drop(*[f"__{x}{k}" for k in range(len(tables)) for x in "kv"])


def known_causes(findings: DataFrame, causes: DataFrame, rule: str, unknown: str = "not classified") -> DataFrame:
    """findings with cause and remedy of their rule from (rule, cause, remedy); a rule without an entry is `unknown`, its remedy null."""
    known = causes.select(F.col(rule).alias("__rule"), "cause", "remedy")
    found = findings.join(known, F.col(rule) == F.col("__rule"), "left").drop("__rule")
    return found.withColumn("cause", F.coalesce("cause", F.lit(unknown)))


def membership(rows: DataFrame, members: DataFrame, key: str, yes: str = "Y", no: str = "N") -> DataFrame:
    """rows with `member`: yes where the key is among the members."""
    known = members.select(F.col(key).alias("__m")).distinct()
    return rows.join(known, F.col(key) == F.col("__m"), "left").withColumn("member", F.when(F.col("__m").isNotNull(), yes).otherwise(no)).drop("__m")


def union_by_priority(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """All rows of the parts, of equal keys only the one of the earliest part, with dense ordinals from 0."""
    tagged = None
    for k, p in enumerate(parts):
        p = p.withColumn("__p", F.lit(k))
        tagged = p if tagged is None else tagged.unionByName(p)
    first = Window.partitionBy(key).orderBy("__p", order)
    once = tagged.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    return ranked(once, ["__p", order], "ordinal", 0).drop("__p")


def running_offsets(sizes: DataFrame, order: list[str], size: str, start: int) -> DataFrame:
    """sizes with `offset`: start plus the sizes of all rows before, in ranges of the order."""
    ranges = materialize(sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    return offsets_in_parts(ranges, "__part", order, size, start).drop("__part")


def offsets_in_parts(sizes: DataFrame, part: str, order: list[str], size: str, start: int) -> DataFrame:
    """The same for rows in numbered parts: only the parts' totals meet in one task."""
    totals = sizes.groupBy(part).agg(F.sum(size).alias("__t"))
    ahead = totals.withColumn("__base", F.lit(start) + F.coalesce(F.sum("__t").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = sizes.withColumn("__w", F.coalesce(F.sum(size).over(w), F.lit(0)))
    return within.join(F.broadcast(ahead.select(part, "__base")), part).withColumn("offset", F.col("__base") + F.col("__w")).drop("__base", "__w")


def fill_down(rows: DataFrame, key: list[str], order: str, mark: Column, name: str) -> DataFrame:
    """rows with `name`: the last non-null mark at or above each row."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(mark, ignorenulls=True).over(w))


def marker_sessions(rows: DataFrame, key: list[str], order: str, opens: Column) -> DataFrame:
    """rows with `session`: how many rows that open a session lie at or above."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("session", F.sum(opens.cast("long")).over(w))
