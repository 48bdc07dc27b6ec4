"""Deterministic, partition-independent row order.

``ordered_hash(seed, key)`` is ``md5(seed ':' key)``, identical in Spark and
DuckDB; ``hash52`` is its first 13 hex digits as an exact integer (fits a
double), which orders rows exactly like the full digest except on a 52-bit
collision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepforge.functions.stats import order_stats, qcol


def ordered_hash(seed: int | str, key: Column | str) -> Column:
    k = qcol(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), k.cast("string")))


def hash52(seed: int | str, key: Column | str) -> Column:
    return F.conv(F.substring(ordered_hash(seed, key), 1, 13), 16, 10).cast("long").cast("double")


def rank_cuts(df: DataFrame, h: Column, ranks: list[int], n: int | None = None) -> list[float]:
    """Exact hash value of each 0-based rank of the hash order, without a
    global sort (histogram radix select; see ``stats.order_stats``)."""
    if not ranks:
        return []
    return order_stats(df, {"h": h}, {"h": ranks})["h"]
