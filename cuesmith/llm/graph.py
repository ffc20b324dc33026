"""Connected components of links between row numbers, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuesmith.llm.common import discard, save


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over links (a, b), a > b: a node's neighbours move to the smallest node next to it (large: only larger neighbours)."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    moved = both.join(least, "a")
    moved = moved.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")) if large else moved.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) between numbers, in any order: rows (node, component), component the smallest node that links reach.

    Nodes without links aren't in it. Each step is a map-side minimum and a join whose large side Spark may split, so a hot node is no
    bottleneck; steps are written to shared storage and their number grows with the logarithm of the longest chain. Repeated links,
    links of a node with itself and no links at all are allowed.
    """
    links = save(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    mark = None
    while True:
        after = save(_star(_star(links, large=True), large=False))
        found = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(links)
        links = after
        if found == mark:
            break
        mark = found
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
