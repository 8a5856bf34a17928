"""Spectra as arrays and as points: conversion, order, masking, chunks, images.

Array functions take columns and stay inside whole-stage code generation; point functions take DataFrames with a
spectrum key, an m/z and an intensity column.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakloom.operators import arrays

#: Width of an m/z chunk.
CHUNK_WIDTH = 50.0


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def explode_points(df: DataFrame, mz: str = "mz", intensity: str = "intensity") -> DataFrame:
    """One row per point: the other columns, point_index, mz, intensity. Empty arrays give no rows."""
    rest = [c for c in df.columns if c not in (mz, intensity)]
    cells = df.select(*rest, F.posexplode(F.arrays_zip(F.col(mz).alias("mz"), F.col(intensity).alias("intensity"))).alias("point_index", "p"))
    return cells.select(*rest, "point_index", F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))


def collect_points(points: DataFrame, keys: list[str]) -> DataFrame:
    """The inverse of explode_points: arrays in the order of point_index."""
    zipped = F.sort_array(F.collect_list(F.struct("point_index", "mz", "intensity")))
    return points.groupBy(*keys).agg(zipped.alias("p")).select(*keys, F.col("p.mz").alias("mz"), F.col("p.intensity").alias("intensity"))


def positions(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))


def sort_parallel(mz: Column, others: dict[str, Column]) -> Column:
    """Struct of mz and the other arrays in ascending m/z, ties in stored order; arrays of another length stay as they are."""
    order = F.array_sort(F.arrays_zip(mz.alias("v"), positions(mz).alias("i")))
    out = [F.transform(order, lambda s: s["v"]).alias("mz")]
    for name, a in others.items():
        out.append(F.when(F.size(a) == F.size(mz), permuted(a, order)).otherwise(a).alias(name))
    return F.struct(*out)


def permuted(a: Column, order: Column) -> Column:
    return F.transform(order, lambda s: F.get(a, s["i"]))


def is_ascending(a: Column) -> Column:
    """Whether no value is below the one before it (no points: true)."""
    return F.coalesce(F.forall(F.zip_with(a, F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: y.isNull() | (x <= y)), lambda ok: ok), F.lit(True))


def first_descent(a: Column) -> Column:
    """Place (from 0) of the first value that isn't above the one before it; null if there is none."""
    bad = F.zip_with(a, F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: y.isNotNull() & ~(x < y))
    at = F.array_position(bad, True)
    return F.when(at > 0, at)


def first_non_finite(a: Column) -> Column:
    """Place (from 0) of the first null, NaN or infinite value; null if there is none."""
    at = F.array_position(F.transform(a, lambda x: ~finite(x)), True)
    return F.when(at > 0, at - 1)


def tic(intensity: Column) -> Column:
    """Sum in stored order, in double precision."""
    return F.aggregate(intensity, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mask_zero_runs(mz: Column, intensity: Column) -> Column:
    """Array of (mz, intensity): every non-zero point and every zero beside a non-zero one. A missing neighbour counts as zero."""
    zipped = F.arrays_zip(mz.alias("mz"), intensity.alias("intensity"))
    near = lambda i: F.coalesce(F.get(intensity, i), F.lit(0)) != 0
    return F.filter(zipped, lambda p, i: (p["intensity"] != 0) | near(i - 1) | near(i + 1))


def mask_zero_points(points: DataFrame, key: str, order: str, intensity: str) -> DataFrame:
    """The same for points, by a window over each spectrum."""
    w = Window.partitionBy(key).orderBy(order)
    beside = lambda k: F.coalesce(F.lag(intensity, k).over(w), F.lit(0)) != 0
    keep = (F.col(intensity) != 0) | beside(1) | beside(-1)
    return points.withColumn("__keep", keep).filter("__keep").drop("__keep")


def rank_points(points: DataFrame, key: str, mz: str) -> DataFrame:
    """Points with their rank (from 1) in ascending m/z."""
    return points.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(mz)))


def mz_chunks(points: DataFrame, key: str, mz: str, width: float = CHUNK_WIDTH) -> DataFrame:
    """(key, chunk, n, lo, hi) of the chunks of fixed width that have points."""
    chunk = F.floor(F.col(mz) / F.lit(width)).alias("chunk")
    return points.groupBy(key, chunk).agg(F.count(F.lit(1)).alias("n"), F.min(mz).alias("lo"), F.max(mz).alias("hi"))


def chunk_points(points: DataFrame, key: str, mz: str = "mz", intensity: str = "intensity", width: float = CHUNK_WIDTH, window: tuple[float, float] | None = None) -> DataFrame:
    """(key, chunk, chunk_start, chunk_end, mz, intensity): arrays in m/z order for each spectrum and chunk that has points.

    The bounds are those of the points, so a window of m/z prunes whole chunks by them, also in Parquet. window: only
    chunks that it meets are made; the filter on m/z reaches the scan of the points.
    """
    if window:
        low, high = (math.floor(w / width) * width for w in window)
        points = points.filter((F.col(mz) >= low) & (F.col(mz) < high + width))
    zipped = F.array_sort(F.collect_list(F.struct(F.col(mz).alias("m"), F.col(intensity).alias("v"))))
    found = points.groupBy(key, F.floor(F.col(mz) / F.lit(width)).alias("chunk")).agg(F.min(mz).alias("chunk_start"), F.max(mz).alias("chunk_end"), zipped.alias("p"))
    return found.select(key, "chunk", "chunk_start", "chunk_end", F.col("p.m").alias("mz"), F.col("p.v").alias("intensity"))


def chunk_window(chunks: DataFrame, key: str, low: float, high: float) -> DataFrame:
    """(key, tic, n) of the points of chunks within [low, high]; the filter on bounds goes before the arrays are read."""
    met = chunks.filter((F.col("chunk_end") >= low) & (F.col("chunk_start") <= high))
    inside = F.filter(F.arrays_zip("mz", "intensity"), lambda p: p["mz"].between(low, high))
    part = met.select(key, inside.alias("p")).select(key, tic(F.col("p.intensity")).alias("t"), F.size("p").alias("c")).filter("c > 0")
    return part.groupBy(key).agg(F.sum("t").alias("tic"), F.sum("c").alias("n"))


def delta_encode(a: Column) -> Column:
    """The first value, then the differences."""
    return F.transform(a, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(a, i - 1)))


def delta_decode(a: Column) -> Column:
    """Running sums: the inverse of delta_encode up to rounding (bit_deltas has none), in linear time by Arrow batches."""

    @F.arrow_udf("array<double>")
    def sums(lists: pa.Array) -> pa.Array:
        values, offsets, gone = arrays.flat(lists)
        out = [np.cumsum(values[x:y]) for x, y in zip(offsets, offsets[1:], strict=False)]
        return arrays.lists(np.concatenate(out or [np.zeros(0)]), np.diff(offsets), gone, pa.float64())

    return sums(a)


def bit_deltas(a: Column) -> Column:
    """Differences of the bit patterns of doubles as whole numbers: lossless whatever the values, and small for ascending ones."""

    @F.arrow_udf("array<long>")
    def differences(lists: pa.Array) -> pa.Array:
        values, offsets, gone = arrays.flat(lists)
        return arrays.lists(arrays.bit_deltas(values, offsets[:-1][np.diff(offsets) > 0]), np.diff(offsets), gone, pa.int64())

    return differences(a)


def from_bit_deltas(a: Column) -> Column:
    """The inverse of bit_deltas."""

    @F.arrow_udf("array<double>")
    def values(lists: pa.Array) -> pa.Array:
        gone = lists.is_null().to_numpy(zero_copy_only=False)
        sizes = np.where(gone, 0, lists.value_lengths().fill_null(0).to_numpy())
        found = arrays.from_bit_deltas(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(sizes)])
        return arrays.lists(found, sizes, gone, pa.float64())

    return values(a)


def narrowed(values: Column) -> tuple[Column, Column]:
    """(values as single precision holds them, whether that changes them)."""
    single = values.cast("float").cast("double")
    return single, single != values


def tic_by_spectrum(points: DataFrame, key: str, intensity: str) -> DataFrame:
    """(key, tic, n)."""
    return points.groupBy(key).agg(F.sum(intensity).alias("tic"), F.count(F.lit(1)).alias("n"))


def sort_with_mobility(mz: Column, mobility: Column, intensity: Column) -> Column:
    """Struct of mz, mobility and intensity by m/z, then mobility; nothing is moved where the lengths differ."""
    order = F.array_sort(F.arrays_zip(mz.alias("m"), mobility.alias("d"), positions(mz).alias("i")))
    same = (F.size(mz) == F.size(mobility)) & (F.size(mz) == F.size(intensity))
    by = lambda a: F.when(same, permuted(a, order)).otherwise(a)
    return F.struct(by(mz).alias("mz"), by(mobility).alias("mobility"), by(intensity).alias("intensity"))


def image_grid(spectra: DataFrame, order: str, nx: int, ny: int) -> tuple[DataFrame, DataFrame]:
    """(y, x, tic, present) of every cell of the grid, and one row (dropped): pixels that lie outside it.

    spectra has x, y, tic; of several on a cell the last one by `order` counts. Cells without one have tic 0.
    """
    inside = F.col("x").between(1, nx) & F.col("y").between(1, ny)
    last = spectra.filter(inside).groupBy("y", "x").agg(F.max_by("tic", order).alias("tic"))
    rows = spectra.sparkSession.range(1, ny + 1).select(F.col("id").alias("y"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(nx).cast("long"))).alias("x"))
    cells = rows.join(last, ["y", "x"], "left").select("y", "x", F.coalesce("tic", F.lit(0.0)).alias("tic"), F.col("tic").isNotNull().alias("present"))
    return cells, spectra.agg(F.count_if(~F.coalesce(inside, F.lit(False))).alias("dropped"))


def ion_image(spectra: DataFrame, points: DataFrame, key: str = "spectrum", intensity: str = "intensity", window: tuple[float, float] | None = None, mz: str = "mz") -> DataFrame:
    """(y, x, tic, present): each pixel's summed intensity, in an m/z window if given. Pixels without points are absent.

    The points are summed per spectrum before they meet the pixels.
    """
    if window:
        points = points.filter(F.col(mz).between(*window))
    sums = points.groupBy(key).agg(F.sum(intensity).alias("tic"))
    grid = spectra.join(sums, key, "left")
    return grid.select("y", "x", F.coalesce("tic", F.lit(0.0)).alias("tic"), F.col("tic").isNotNull().alias("present"))


def overview(points: DataFrame, key: str, mz: str, intensity: str) -> DataFrame:
    """Per spectrum: tic, base peak (of the highest ones that with the least m/z), m/z range."""
    best = F.max(F.struct(F.col(intensity), -F.col(mz)))
    got = points.groupBy(key).agg(F.sum(intensity).alias("tic"), best.alias("b"), F.min(mz).alias("mz_lo"), F.max(mz).alias("mz_hi"))
    return got.select(key, "tic", (-F.col("b.col2")).alias("base_mz"), F.col(f"b.{intensity}").alias("base_intensity"), "mz_lo", "mz_hi")


def image_difference(a: DataFrame, b: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """One row: cells of two images, and those that differ in presence or by more than the tolerance relative to a."""
    left = a.select("y", "x", F.col("tic").alias("ta"), F.col("present").alias("pa"))
    right = b.select("y", "x", F.col("tic").alias("tb"), F.col("present").alias("pb"))
    both = left.join(right, ["y", "x"], "full_outer")
    presence = F.coalesce("pa", F.lit(False)) != F.coalesce("pb", F.lit(False))
    off = F.coalesce(F.abs(F.col("tb") - F.col("ta")) > F.lit(tolerance) * F.abs("ta"), F.lit(False)) | F.isnan(F.coalesce("ta", F.lit(0.0))) | F.isnan(F.coalesce("tb", F.lit(0.0)))
    return both.agg(F.count(F.lit(1)).alias("cells"), F.count_if(presence).alias("presence_differs"), F.count_if(~presence & off).alias("tic_differs"))


def shared_axes(df: DataFrame, mz: str = "mz") -> tuple[DataFrame, DataFrame]:
    """(spectra with axis_id in place of mz, axes): equal m/z arrays are stored once, by a key of 128 bits."""
    keyed = df.withColumn("axis_id", F.concat_ws(":", F.xxhash64(mz), F.xxhash64(F.lit(7), mz)))
    axes = keyed.groupBy("axis_id").agg(F.first(mz).alias(mz))
    return keyed.drop(mz), axes
