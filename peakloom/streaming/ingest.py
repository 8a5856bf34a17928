"""Structured Streaming over arriving spectra: a deduplicated stream and its running fold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from peakloom.operators.signal import finite
from peakloom.sources import archive


def arriving(spark: SparkSession, folder: str, schema: StructType, files: int = 100) -> DataFrame:
    """A stream of Parquet rows as files arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def once(stream: DataFrame, keys: list[str], event_time: str | None = None, late: str = "1 hour") -> DataFrame:
    """The stream without rows whose keys were seen; with an event time, state older than `late` is given up."""
    if event_time:
        return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def running_fold(points: DataFrame, keys: list[str], mz: str, intensity: str) -> DataFrame:
    """Per key the running sum, count and finite m/z range: a commutative fold, so it can be kept up incrementally."""
    ok = finite(F.col(mz))
    return points.groupBy(*keys).agg(F.sum(intensity).alias("tic"), F.count(F.lit(1)).alias("n"), F.min(F.when(ok, F.col(mz))).alias("mz_lo"), F.max(F.when(ok, F.col(mz))).alias("mz_hi"))


def windowed_fold(events: DataFrame, event_time: str, width: str, keys: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    """Sum and count by tumbling window and keys; windows are given up `late` after their end."""
    return events.withWatermark(event_time, late).groupBy(F.window(event_time, width).alias("w"), *keys).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), *keys, "total", "n")


def append_to(stream: DataFrame, folder: str, checkpoint: str):
    """Write the stream to Parquet, exactly once; runs until what has arrived is processed."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def commit(spark: SparkSession, batch: DataFrame, path: str, number: int, **options) -> bool:
    """Write a batch of spectra as the archive `path/batch=number`; whether it was written.

    An archive counts once its index is there, which is written last: a batch that comes again is left alone, and what
    a commit left that didn't end is written anew. options: those of archive.write_archive.
    """
    at = f"{path}/batch={number}"
    if archive.exists(spark, f"{at}/index/_SUCCESS"):
        return False
    archive.delete(spark, at)
    archive.write_archive(batch, at, **options)
    return True


def into_archives(stream: DataFrame, path: str, checkpoint: str, **options):
    """Write a stream of spectra into an archive a batch, each exactly once; runs until what has arrived is processed."""

    def each(batch: DataFrame, number: int) -> None:
        commit(batch.sparkSession, batch, path, number, **options)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def committed(spark: SparkSession, path: str) -> list[str]:
    """The archives of the batches that were committed, in their order."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []
    numbers = sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
    return [f"{path}/batch={n}" for n in numbers if archive.exists(spark, f"{path}/batch={n}/index/_SUCCESS")]


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The spectra of all committed batches, with the number of their batch."""
    out = None
    for at in committed(spark, path):
        one = archive.read_archive(spark, at).withColumn("batch", F.lit(int(at.rpartition("=")[2])).cast("long"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"{path} has no committed batch")
    return out


#: What is read of an index for the fold of a run that arrives in batches.
FOLD = "spectra long, resorted long, content array<string>, fold struct<max_x:long,max_y:long,mz_lo:double,mz_hi:double>"


def committed_fold(spark: SparkSession, path: str) -> DataFrame:
    """One row (batches, spectra, resorted, max_x, max_y, mz_lo, mz_hi, has_ms1, has_msn) of a run in batches: each was folded when it was committed, and only the indexes are read."""
    found = committed(spark, path)
    rows = spark.read.text([f"{at}/index" for at in found]) if found else spark.createDataFrame([], "value string")
    i = rows.select(F.from_json("value", FOLD).alias("i")).select("i.*")
    has = lambda kind: F.coalesce(F.bool_or(F.array_contains("content", kind)), F.lit(False))
    return i.agg(
        F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("spectra"), F.lit(0)).alias("spectra"), F.coalesce(F.sum("resorted"), F.lit(0)).alias("resorted"), F.max("fold.max_x").alias("max_x"), F.max("fold.max_y").alias("max_y"),
        F.min("fold.mz_lo").alias("mz_lo"), F.max("fold.mz_hi").alias("mz_hi"), has("ms1").alias("has_ms1"), has("msn").alias("has_msn"),
    )
