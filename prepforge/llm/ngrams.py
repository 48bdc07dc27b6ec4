"""Hashed word n-gram multinomials over a corpus, in DataFrame operations: the
model shared by the quality rules and importance resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Target ids are broadcast up to this many (8 bytes each), joined by shuffle beyond.
BROADCAST_IDS = 4_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def buckets(w: Column, n: int) -> Column:
    """Hash buckets (from 1) of all words and all pairs of neighbours."""
    one = F.transform(w, lambda x: (F.pmod(F.xxhash64(x), F.lit(n)) + 1).cast("int"))
    less = F.greatest(F.size(w) - 1, F.lit(0))
    two = F.zip_with(F.slice(w, F.lit(1), less), F.slice(w, F.lit(2), less), lambda x, y: (F.pmod(F.xxhash64(x, y), F.lit(n)) + 1).cast("int"))
    return F.concat(one, two)


def flag_targets(docs: DataFrame, target_ids: DataFrame, out: str) -> DataFrame:
    """``docs`` (with ``doc_id``) plus whether the id is among the (distinct,
    non-NULL) target ids."""
    ids = target_ids.select(F.col("doc_id").alias(f"{out}_id")).where(F.col(f"{out}_id").isNotNull()).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col("doc_id") == F.col(f"{out}_id"), "left").withColumn(out, F.col(f"{out}_id").isNotNull()).drop(f"{out}_id")


def log_ratios(flagged: DataFrame, n: int, smooth: float = 1.0) -> list[float]:
    """Per bucket log p(target) - log p(raw), add-``smooth`` smoothed.
    ``flagged`` (words ``w``, target) holds every document; the counts combine
    before the shuffle and at most ``n`` rows reach the driver. Each word is
    exploded with the one after it, so that the buckets (those of ``buckets``)
    are hashed in generated code."""
    bucket = lambda *x: (F.pmod(F.xxhash64(*x), F.lit(n)) + 1).cast("int")
    pairs = flagged.select("target", F.explode(F.arrays_zip(F.col("w").alias("x"), F.slice("w", F.lit(2), F.size("w")).alias("y"))).alias("z")).select("target", "z.*")
    grams = pairs.select("target", F.explode(F.array(bucket("x"), F.when(F.col("y").isNotNull(), bucket("x", "y")))).alias("b"))
    rows = (grams.where(F.col("b").isNotNull()).groupBy("b")
            .agg(F.count(F.lit(1)).alias("raw"), F.count_if("target").alias("own")).collect())
    raw, own = [smooth] * n, [smooth] * n
    for r in rows:
        raw[r["b"] - 1] += r["raw"]
        own[r["b"] - 1] += r["own"]
    all_raw, all_own = math.log(sum(raw)), math.log(sum(own))
    return [round(math.log(p) - all_own - math.log(q) + all_raw, 5) for p, q in zip(own, raw, strict=True)]


def summed(grams: Column, ratios: list[float]) -> Column:
    """Sum of the log ratios of a document's n-grams, in their order."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")
    return F.aggregate(grams, F.lit(0.0), lambda acc, b: acc + F.element_at(table, b))
