"""Connected components by alternating large and small stars, all in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that has an edge in edges(a, b); component is the smallest node reachable.

    Each round hangs neighbours on smaller nodes and is written to the shared folder; a graph of n nodes takes some
    log(n) rounds. A node of very many edges is pre-aggregated, and the joins are open to Spark's skew handling.
    """
    now = materialize(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = materialize(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        then = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        state = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
        if now.agg(*state).first() == then.agg(*state).first():
            break
        now = then
    tree = then.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return tree.union(then.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
