"""Connected components of a graph of links, by alternating large and small stars on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, drop_tables


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Links each node's greater (large star) or smaller (small star) neighbours to its least one, or to itself."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    else:
        near = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
        near = near.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = near.groupBy("node").agg(F.min("other").alias("least")).withColumn("least", F.least("node", "least"))
    joined = near.join(least, "node")
    if small:
        to = joined.select(F.col("other").alias("a"), F.col("least").alias("b"))
        to = to.unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    else:
        to = joined.where("other > node").select(F.col("other").alias("a"), F.col("least").alias("b"))
    return to.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component (the least node that it reaches) of each node of the edges (a, b: long)."""
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    sign = None
    while True:
        new = cut_lineage(_star(_star(now, small=False), small=True), "stars", release=False)
        drop_tables(now.sparkSession, now)
        now = new
        total = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        then, sign = sign, tuple(now.agg(F.count("*"), total).first())
        if sign == then:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
