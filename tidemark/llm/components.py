"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's greater (large) or lesser (small) neighbours, and the node, move to its least neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
    moved = both.join(least, "a")
    moved = moved.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")) if large else moved.select("b", "low").toDF("a", "b").unionByName(least.select("a", F.col("low").alias("b")))
    return moved.filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, least: for each node of the edges (a, b), the least node of its component. Each round is written to the shared folder."""
    now, before = written(edges.filter("a != b").distinct(), "edges"), None
    while True:
        now = written(_star(_star(now, True), False), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("least")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("least"))).distinct()
