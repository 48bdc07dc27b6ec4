"""Flagship query: the minimum end-to-end slice of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepforge.plans.pipeline import PrepPipeline
from prepforge.suite.frames import frame_E
from prepforge.operators.split import tag_split


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with missing values -> md5 split -> mean/mode imputation ->
    standard scaling -> one-hot -> per-split summary of the prepared frame."""
    df = tag_split(frame_E(spark, sf_dir), "event_id")
    pipe = PrepPipeline({"imputation": "mean", "scaling": "standard", "encoding": "onehot"})
    model = pipe.fit(df, ["value_m", "user_m", "type_m"], label="event_type", split_col="split")
    out = model.transform(df)
    feats = model.output_cols
    hot = [c for c in feats if c.startswith("type_m_")]
    return (out.groupBy("split")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.round(F.avg("value_m"), 6).alias("mean_value_m"),
                 F.round(F.stddev_pop("value_m"), 6).alias("std_value_m"),
                 F.round(F.avg("user_m"), 6).alias("mean_user_m"),
                 F.round(F.avg(sum((F.col(c) for c in hot), F.lit(0.0))), 6).alias("hot_per_row"),
                 F.lit(len(feats)).alias("n_features"))
            .orderBy("split"))
