"""Connected components by alternating stars.

Large star hangs each node's larger neighbours on the least node that it
knows, small star the smaller ones; edges turn into stars around the least
node of each component in a number of rounds that is logarithmic in practice.
Every round is written to the shared folder, so that lost executors cost one
round at most, and so that both sides of each join are plain tables, whose hot
keys adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_path, written


def _least(edges: DataFrame) -> tuple[DataFrame, str]:
    return written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the least node of each component, for every node of ``edges`` (longs); no edges give no rows."""
    spark = edges.sparkSession
    now, path = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, gone = _least(both)
        large, large_path = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        drop_path(spark, gone)
        least, gone = _least(large)
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after, after_path = written(small.filter("u <> v").distinct(), "edges")
        for done in (gone, large_path, path):
            drop_path(spark, done)
        now, path, before, state = after, after_path, state, _state(after)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
