"""Quality selection by importance resampling (operator 2).

Two hashed n-gram generative models are counted: the target's (documents that
``labels`` calls good) and the raw corpus's, over all documents. A document's
log importance weight is the log ratio of its probability under the two. The
sample of size k without replacement is the Gumbel top-k: the k largest
``log_weight + Gumbel noise``, the noise a hash of the document and a seed.
The k-th largest key is found by a distributed order statistic over the stored
narrow table, not by a global sort.

Defined results: NULL or blank text has weight 0. Rows equal in id and text
share their key; rows whose key equals the k-th are all kept. Without target
documents all weights are 0 and the sample is uniform.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepforge.functions.stats import order_stats
from prepforge.llm.mixing import coin, coin_key
from prepforge.llm.ngrams import buckets, flag_targets, log_ratios, summed, words
from prepforge.llm.util import col, read_documents, store

BUCKETS = 10_000
#: Share of the documents in the sample.
KEEP = 0.8
SEED = 1


def log_weights(docs: DataFrame, target_ids: DataFrame, n: int = BUCKETS) -> DataFrame:
    """(doc_id, key, log_weight), stored; ``key`` identifies id and text."""
    rows = docs.select(col("doc_id").alias("doc_id"), col("text").alias("text"))
    flagged = flag_targets(rows.select("doc_id", words(F.col("text")).alias("w")), target_ids, "target")
    ratios = log_ratios(flagged, n)
    if len(set(ratios)) == 1:  # no target document
        ratios = [0.0] * n
    return store(rows.select("doc_id", coin_key(F.col("doc_id"), F.col("text")).alias("key"), words(F.col("text")).alias("w"))
                 .select("doc_id", "key", summed(buckets(F.col("w"), n), ratios).alias("log_weight")), "weights")


def gumbel_top_k(weights: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """``weights`` plus ``score`` (weight with noise) and ``kept``."""
    u = coin(F.col("key"), F.lit(f"gumbel{seed}")) + F.lit(2.0 ** -53)
    scored = store(weights.withColumn("score", F.col("log_weight") - F.log(-F.log(u))), "gumbel")
    n = scored.count()
    if k <= 0 or n == 0:
        return scored.withColumn("kept", F.lit(k >= n > 0))
    cut = order_stats(scored, {"score": F.col("score")}, {"score": [max(n - k, 0)]})["score"][0]
    return scored.withColumn("kept", F.col("score") >= F.lit(cut))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = log_weights(docs, labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)))
    return gumbel_top_k(weights, round(KEEP * weights.count())).select("doc_id", "log_weight", "score", "kept")
