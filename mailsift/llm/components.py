"""Connected components of an edge table: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailsift.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Connect the larger (or the smaller and equal) neighbours of each node to its smallest one."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = stored(both.groupBy("u").agg(F.min("v").alias("m")), "star-lowest")
    joined = both.join(lowest, "u").withColumn("m", F.least("m", "u"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            joined.select("u", F.col("m").alias("v"))
        )
    return out.where("u <> v").distinct()


def components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component_id)`` for every node of an edge, with the smallest node reachable.

    Every step is a grouped minimum (combined before the shuffle) and a join of two stored or
    shuffled tables, so a node with very many neighbours can be split. The number of rounds grows
    with the logarithm of the longest path. An edge with a null end is left out.
    """
    current = stored(
        edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct(), "edges"
    )
    seen = None
    for _ in range(max_rounds):
        current = stored(_star(stored(_star(current, True), "large-star"), False), "small-star")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component_id", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(roots)
