"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepforge.session import cut_lineage


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour is linked to the smallest of its group."""
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Smaller neighbours and the node itself are linked to the smallest."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    inner = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v: long, u != v) -> (u, v): every node but the smallest
    of its component, with that smallest node. Rounds are checkpointed; only
    two numbers a round reach the driver."""
    e = cut_lineage(edges.select("u", "v").distinct())
    seen = None
    while True:
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or now[0] == 0:
            return e
        seen = now
        e = cut_lineage(_small_star(_large_star(e)))
