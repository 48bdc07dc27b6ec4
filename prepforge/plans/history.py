"""Run history as analytic tables (HIS1-4, EVL4-5, CAT6).

``history`` rows: (trial, epoch, val_loss, val_acc, ...). Every per-trial
computation groups by trial (one trial's epochs per group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the stopping rule.
MIN_GAIN = 0.001
PATIENCE = 3


def scalar_log(history: DataFrame, metrics: list[str]) -> DataFrame:
    """HIS1: (trial, name, epoch, value)."""
    return history.unpivot(["trial", "epoch"], metrics, "name", "value")


def best_epoch(history: DataFrame) -> DataFrame:
    """EVL5: the record of the epoch with the lowest validation loss
    (earliest epoch on a tie)."""
    best = F.min_by(F.struct("epoch", "val_loss", "val_acc"), F.struct("val_loss", "epoch"))
    return history.groupBy("trial").agg(best.alias("b")).select(
        "trial", F.col("b.epoch").alias("best_epoch"), F.col("b.val_loss").alias("best_val_loss"),
        F.col("b.val_acc").alias("best_val_acc"))


def best_option(probs: DataFrame) -> DataFrame:
    """HIS3: per (epoch, stage, feature) the most probable option as
    ``"option:0.55"``; stages concatenated per feature in stage order."""
    top = (probs.groupBy("epoch", "stage", "feature")
           .agg(F.min_by(F.struct("option", "prob"), F.struct((-F.col("prob")).alias("np"), "option")).alias("m"))
           .select("epoch", "stage", "feature",
                   F.format_string("%s:%.2f", F.col("m.option"), F.col("m.prob")).alias("best")))
    return (top.groupBy("epoch", "feature")
            .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("stage", "best"))),
                                          lambda s: s["best"]), " | ").alias("pipeline")))


def early_stop(history: DataFrame, interval: int = 1, patience: int = PATIENCE,
               min_gain: float = MIN_GAIN) -> DataFrame:
    """EVL4: replay the stopping rule per trial over its epochs in order.
    Every ``interval`` epochs: if the best record's val acc improved by less
    than ``min_gain`` since the last check, patience drops by one, else it
    resets; training stops when patience reaches 0."""
    recs = F.sort_array(F.collect_list(F.struct("epoch", "val_loss", "val_acc")))
    init = F.struct(F.lit(float("inf")).alias("bl"), F.lit(None).cast("double").alias("ba"),
                    F.lit(None).cast("int").alias("be"), F.lit(float("-inf")).alias("last"),
                    F.lit(patience).alias("pat"), F.lit(None).cast("int").alias("stop"))

    def step(acc, r):
        better = r["val_loss"] < acc["bl"]
        bl = F.when(better, r["val_loss"]).otherwise(acc["bl"])
        ba = F.when(better, r["val_acc"]).otherwise(acc["ba"])
        be = F.when(better, r["epoch"]).otherwise(acc["be"])
        check = (r["epoch"] % F.lit(interval) == 0) & acc["stop"].isNull()
        small = (ba - acc["last"]) < F.lit(min_gain)
        pat = F.when(check & small, acc["pat"] - 1).when(check, F.lit(patience)).otherwise(acc["pat"])
        last = F.when(check & ~small, ba).otherwise(acc["last"])
        stop = F.when(acc["stop"].isNull() & (pat <= 0), r["epoch"]).otherwise(acc["stop"])
        frozen = acc["stop"].isNotNull()
        return F.when(frozen, acc).otherwise(F.struct(bl.alias("bl"), ba.alias("ba"), be.alias("be"),
                                                       last.alias("last"), pat.alias("pat"), stop.alias("stop")))

    out = history.groupBy("trial").agg(F.aggregate(recs, init, step).alias("s"))
    return out.select("trial", F.col("s.stop").alias("stop_epoch"), F.col("s.be").alias("best_epoch"),
                      F.col("s.ba").alias("best_val_acc"))


def top_results(history: DataFrame, n: int = 10) -> DataFrame:
    """CAT6: best ``n`` results by accuracy (the limit is the feature)."""
    return history.orderBy(F.desc("val_acc"), "trial", "epoch").limit(n).select("trial", "epoch", "val_acc")


def result_summary(history: DataFrame) -> DataFrame:
    return history.agg(F.avg("val_acc").alias("mean_acc"), F.median("val_acc").alias("median_acc"),
                       F.count(F.lit(1)).alias("n_results"))


def option_log(spark: SparkSession, probs_log: list[tuple]) -> DataFrame:
    """HIS2: (epoch, stage, feature, option, prob), the probabilities of a
    search after each update."""
    return spark.createDataFrame(probs_log, "epoch int, stage int, feature string, option string, prob double")


def order_log(spark: SparkSession, order_log: list[tuple]) -> DataFrame:
    """HIS4: (epoch, feature, position, stage, prob), the place that a
    flexible search gives to each stage after each update."""
    return spark.createDataFrame(order_log, "epoch int, feature string, position int, stage string, prob double")
