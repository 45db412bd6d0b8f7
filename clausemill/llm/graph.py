"""Connected components of an edge table, without gathering a component anywhere.

Alternating large and small stars: every vertex moves to the smallest neighbour of its
neighbours until each component is a star around its smallest vertex. Each round reads and
writes tables in the shared folder; minima are pre-aggregated, and the joins are plain
sort-merge joins, in which Spark splits a hot centre.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clausemill.llm import common


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``edges`` (a, b: long) to (v, root) for every vertex that has an edge to another; root is the smallest.

    Loops and repeated edges don't matter; nulls are left out; no edges give an empty table.
    """
    pairs = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = common.keep(pairs, name)
    before = _signature(now)
    while before[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = common.keep(both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("m")), name)
        large = common.keep(now.join(low, now.v == low.c).select("u", F.col("m").alias("v")).where("u > v").distinct(), name)
        least = common.keep(large.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")), name)
        moved = large.join(least, large.u == least.c).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = common.keep(moved.union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct(), name)
        common.drop(now, low, large, least)
        now, last = after, before
        before = _signature(now)
        if before == last:
            break
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v").alias("root")).distinct())
