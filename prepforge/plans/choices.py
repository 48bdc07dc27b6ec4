"""Choice tables of a pipeline search (PIP10-12, PIP15).

A choice table has one row per (stage, feature, option) with a logit; all
per-feature normalisations are windows partitioned by (stage, feature), so
each window holds one feature's options (a handful of rows), never the
table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the choice initialisation.
PRIOR_DEFAULT = 0.5
SINKHORN_TOL = 1e-6
SINKHORN_ITERS = 500

_W = ["stage", "feature"]


def choice_prior(options: DataFrame, default_option: str, p0: float = PRIOR_DEFAULT) -> DataFrame:
    """PIP10: the default option gets ``p0``, the others share ``1 - p0``;
    logit = ln(prob)."""
    w = Window.partitionBy(*_W)
    t = F.count(F.lit(1)).over(w)
    prob = (F.when(t == 1, F.lit(1.0)).when(F.col("option") == F.lit(default_option), F.lit(p0))
            .otherwise(F.lit(1.0 - p0) / F.nullif(t - 1, F.lit(0))))
    return options.withColumn("prob", prob).withColumn("logit", F.log(F.col("prob")))


def softmax(choices: DataFrame, logit: str = "logit", out: str = "prob") -> DataFrame:
    """PIP11: stable softmax over each feature's options."""
    w = Window.partitionBy(*_W)
    e = F.exp(F.col(logit) - F.max(logit).over(w))
    return choices.withColumn(out, e / F.sum(e).over(w))


def argmax(choices: DataFrame, score: str = "logit") -> DataFrame:
    """PIP11 ``max_only``: one option per feature; a tie goes to the lowest
    ``option_index`` where the table has one, else to the first name."""
    first = "option_index" if "option_index" in choices.columns else "option"
    w = Window.partitionBy(*_W).orderBy(F.desc(score), F.asc(first))
    return choices.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def gumbel_uniform(seed: int) -> F.Column:
    """Uniform in (0, 1) from md5(seed:feature:option) (52 bits)."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("feature").cast("string"), F.col("option").cast("string")))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def gumbel_argmax(choices: DataFrame, seed: int, temperature: float = 0.1) -> DataFrame:
    """PIP12: hard sample = arg-max of (logit + Gumbel noise) / temperature
    (straight-through one-hot)."""
    g = (F.col("logit") - F.log(-F.log(gumbel_uniform(seed)))) / F.lit(temperature)
    return argmax(choices.withColumn("gumbel_score", g), "gumbel_score")


def sinkhorn(alpha: DataFrame) -> DataFrame:
    """PIP15: per feature, ``exp(X)`` normalised alternately over rows and
    columns until both sums are within 1e-6 of 1 (at most 500 rounds).
    Features are independent: one group per feature."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(max(pdf["position"].max(), pdf["stage_idx"].max())) + 1
        x = np.zeros((s, s))
        x[pdf["position"].to_numpy(), pdf["stage_idx"].to_numpy()] = pdf["logit"].to_numpy()
        m = np.exp(x - x.max())
        for _ in range(SINKHORN_ITERS):
            m = m / m.sum(axis=1, keepdims=True)
            m = m / m.sum(axis=0, keepdims=True)
            if np.all(np.abs(m.sum(axis=1) - 1) < SINKHORN_TOL) and np.all(np.abs(m.sum(axis=0) - 1) < SINKHORN_TOL):
                break
        i, j = np.meshgrid(np.arange(s), np.arange(s), indexing="ij")
        return pd.DataFrame({"feature": pdf["feature"].iloc[0], "position": i.ravel(), "stage_idx": j.ravel(),
                             "prob": m.ravel()})

    ftype = dict(alpha.dtypes)["feature"]
    return alpha.groupBy("feature").applyInPandas(one, f"feature {ftype}, position int, stage_idx int, prob double")
