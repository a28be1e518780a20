"""Connected components by alternating large-star and small-star steps.

Each step regroups edges around the smallest neighbour; a node with very many edges is reduced by a partial
minimum first and joined back (a join AQE can split), never gathered. Edges are written after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import cut_lineage


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); a component is named after its smallest node."""
    now, seen = cut_lineage(edges.where("u <> v").select("u", "v").distinct(), "edges"), None
    while True:
        now = cut_lineage(_small_star(_large_star(now).distinct()), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == mark:
            break
        seen = mark
    named = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
