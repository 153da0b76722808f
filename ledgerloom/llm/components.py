"""Connected components of an edge table by alternating large and small stars, in O(log n) rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.storage import stored


def _stars(pairs: DataFrame) -> DataFrame:
    """One large-star and one small-star step over pairs (high, low). The least neighbour comes from a
    map-side combined minimum joined back, so a node with very many neighbours is never one task's group."""
    both = pairs.union(pairs.select(F.col("low").alias("high"), F.col("high").alias("low")))
    least = both.groupBy("high").agg(F.min("low").alias("to")).withColumn("to", F.least("to", "high"))
    large = (
        pairs.select(F.col("low").alias("node"), F.col("high").alias("next"))
        .join(least.withColumnRenamed("high", "node"), "node")
        .select(F.col("next").alias("high"), F.col("to").alias("low"))
        .distinct()
    )
    down = large.groupBy("high").agg(F.min("low").alias("to"))
    moved = large.join(down, "high").where("low <> to").select(F.col("low").alias("high"), F.col("to").alias("low"))
    return moved.union(down.select("high", F.col("to").alias("low"))).distinct()


def _digest(pairs: DataFrame):
    row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the least node reachable.

    Null ends and loops are ignored; nodes without another end are not listed.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct()
    pairs = stored(pairs, "component-pairs")
    seen = _digest(pairs)
    while seen[0]:
        pairs = stored(_stars(pairs), "component-pairs")
        now = _digest(pairs)
        if now == seen:
            break
        seen = now
    roots = pairs.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return roots.union(pairs.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
