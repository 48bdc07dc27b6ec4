"""Mixing sources to target weights (operator 5), in DataFrame operations.

Words are summed per source. Sources share all words by weight; a target above
``MAX_REPEAT`` times its source's words stops there and the excess is reshared
by weight until no target is above: a water level, found by a loop over the
(aggregated) source table of which only two sums reach the driver. A source's
repetition rate is its target over its words; each document is emitted
``floor(rate)`` times, plus one Bernoulli copy with the fraction as its
probability. The coin is a hash of the document and a seed; per source the
seed is taken, of ``SEEDS`` candidates, whose copies bring the source nearest
to its target, in an aggregation that combines before it shuffles.

Defined results: NULL or blank text has size 0; a source without words has
target 0 and emits nothing; NULL sources are one source, the last. The coin
takes ``doc_id`` and the text, so rows equal in both share it, and a NULL id is
fine. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepforge.llm.util import col, fresh, read_documents, store
from prepforge.plans.catalog import global_positions

# Weights of the sources in code point order, repeating; most copies of a document.
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Candidate seeds of a source's coins.
SEEDS = 8

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def coin_key(doc_id: Column, text: Column) -> Column:
    return F.concat_ws(":", doc_id.cast("string"), F.md5(text.cast("binary")))


def coin(key: Column, seed: Column) -> Column:
    """Uniform in [0, 1), of 52 hash bits (exact in a double)."""
    return F.conv(F.substring(F.md5(F.concat(seed.cast("string"), F.lit(":"), key).cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) of ``sized`` (source, size)."""
    sums = store(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    placed, _ = global_positions(sums, [F.col("source").asc_nulls_last()], "rank")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = store(placed.select("source", "source_size", pick.alias("weight")), "weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # the level only rises, and with it the set of full sources
        full = F.col("weight") * F.lit(level) > F.col("source_size") * most
        taken, open_weight, n = table.agg(F.sum(F.when(full, F.col("source_size") * most)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        rise = (total - (taken or 0)) / open_weight if open_weight else level
        if rise <= level:
            break
        level = rise
    return table.select("source", "source_size", F.when(full, (F.col("source_size") * most).cast("double")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def mix_plan(sized: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """(source, source_size, target, whole, part, seed) of ``sized`` (source,
    size, key): whole copies, probability of one more, and the coin's seed."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = store(source_targets(sized).withColumns({"whole": F.floor(rate), "part": rate - F.floor(rate)}), "rates")
    tossed = sized.join(rates.select(F.col("source").alias("s"), "part"), F.col("source").eqNullSafe(F.col("s")))
    extra = tossed.groupBy("source").agg(F.array(*[
        F.sum(F.when(coin(F.col("key"), F.lit(k)) < F.col("part"), F.col("size")).otherwise(0)) for k in range(seeds)]).alias("extra"))
    off = F.transform("extra", lambda x, k: F.struct(F.abs(F.col("whole") * F.col("source_size") + x - F.col("target")).alias("off"), k.alias("seed")))
    chosen = extra.withColumnRenamed("source", "s").join(rates, F.col("source").eqNullSafe(F.col("s")))
    return store(chosen.select("source", "source_size", "target", "whole", "part", F.array_min(off)["seed"].alias("seed")), "mix-plan")


def sized_rows(docs: DataFrame) -> DataFrame:
    """The narrow (doc_id, source, size, key) of every row, stored."""
    return store(docs.select(col("doc_id").alias("doc_id"), col("source").cast("string").alias("source"), n_words(col("text")).alias("size"),
                             coin_key(col("doc_id"), col("text")).alias("key")), "sized")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = sized_rows(read_documents(spark, sf_dir))
    plan = mix_plan(sized).withColumnRenamed("source", "s")
    copies = F.col("whole") + (coin(F.col("key"), F.col("seed")) < F.col("part")).cast("long")
    return sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the mix itself, documents repeated as planned."""
    plan = mix_plan(sized_rows(docs))
    row = fresh(docs, "row")
    packed = docs.select(F.struct(*[col(c) for c in docs.columns]).alias(row), col("source").cast("string").alias("s"), coin_key(col("doc_id"), col("text")).alias("key"))
    copies = F.col("whole") + (coin(F.col("key"), F.col("seed")) < F.col("part")).cast("long")
    out = packed.join(plan, F.col("s").eqNullSafe(F.col("source"))).where(copies > 0)
    return out.select(row, F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy")).select(*[F.col(row)[c].alias(c) for c in docs.columns])


SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  concat_ws(':', doc_id::VARCHAR, md5(text)) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * ss / w AS ratio, row_number() OVER (ORDER BY 3.0::DOUBLE * ss / w, source NULLS LAST) AS k FROM s),
c AS (SELECT *, (SELECT sum(ss) FROM s) - coalesce(sum(3 * ss) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM r),
l AS (SELECT min_by(rest::DOUBLE / open::DOUBLE, k) AS level FROM c WHERE rest::DOUBLE / open::DOUBLE <= ratio),
t AS (SELECT source, ss, CASE WHEN w * level > 3 * ss THEN (3 * ss)::DOUBLE ELSE w * level END AS target FROM s, l),
p AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END AS whole, CASE WHEN ss > 0 THEN target / ss - floor(target / ss) ELSE 0 END AS part FROM t),
x AS (SELECT d.source, q.seed, any_value(p.whole * p.ss) + sum(CASE WHEN ('0x' || substr(md5(q.seed::VARCHAR || ':' || d.key), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < p.part THEN d.size ELSE 0 END) AS got,
             any_value(p.target) AS target
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source, (SELECT unnest(range(8)) AS seed) q GROUP BY d.source, q.seed),
b AS (SELECT source, seed FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY abs(got - target), seed) AS n FROM x) WHERE n = 1)
SELECT d.doc_id, d.size, p.ss AS source_size, p.target,
       (d.size * (p.whole + CASE WHEN ('0x' || substr(md5(b.seed::VARCHAR || ':' || d.key), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < p.part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
