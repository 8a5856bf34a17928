"""Column expressions and skew-safe lookups that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A key that holds more than one row in HOT_SHARE is looked up by broadcast; there can be at most HOT_SHARE such keys.
HOT_SHARE = 1000


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def crc_mod(name: str, m: int) -> Column:
    """crc32 of the column as text, modulo m (null: 0)."""
    return F.coalesce(F.crc32(F.col(name).cast("string")) % m, F.lit(0))


def release(*tables: DataFrame) -> None:
    """Delete tables that materialize() wrote and that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            at = jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(conf).delete(at, True)


def least_rows(rows: DataFrame, key: str, draw: str, limit: int, ties: list[str]) -> DataFrame:
    """The `limit` rows of each key that have the least draw (a hash, so even over all longs), with `k` from 1.

    The keys are few, such as labels. Their counts tell below which draw some four times as many rows lie as are wanted;
    only those are shuffled, so what meets in one task doesn't grow with the input. Of equal draws `ties` decides.
    """
    counts = rows.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"), F.min(draw).alias("__least"))
    share = F.lit(4.0 * limit) / F.col("__n")
    below = F.when(share >= 1, F.lit(2**63 - 1)).otherwise((share * 2.0**64 - 2.0**63).cast("long"))
    counts = counts.select("__key", F.greatest("__least", below).alias("__below"))
    near = rows.join(F.broadcast(counts), F.col(key).eqNullSafe(F.col("__key"))).filter(F.col(draw) <= F.col("__below")).select(*rows.columns)
    first = Window.partitionBy(key).orderBy(draw, *ties)
    return near.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= limit)


def within_budget(drawn: DataFrame, key: str, size: Column, budget: int) -> DataFrame:
    """Rows of least_rows up to a total size for each key: in the order of their draw, each as a whole, until the budget is used up.

    The row that uses it up is the last one, so the total is less than the budget and one row.
    """
    before = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return drawn.withColumn("__before", F.coalesce(F.sum(size).over(before), F.lit(0))).filter(F.col("__before") < budget).drop("__before")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows left-joined to groups, which has one row per key and its row count in `size`.

    Keys with more than one in HOT_SHARE of all counted rows (at most HOT_SHARE of them, whatever the data) come
    from a broadcast and never meet in one task; the others go through a sort-merge join.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("__total"))
    limit = total.first()["__total"] / HOT_SHARE
    hot = groups.filter(F.col(size) > limit).withColumn("__hot", F.lit(True))
    mapped = rows.join(F.broadcast(hot), key, "left")
    cold = mapped.filter(F.col("__hot").isNull()).select(*rows.columns)
    rest = cold.join(groups.filter(F.col(size) <= limit).hint("merge"), key, "left")
    names = [*rows.columns, *(c for c in groups.columns if c != key)]
    return mapped.filter("__hot").select(*names).unionByName(rest.select(*names))
