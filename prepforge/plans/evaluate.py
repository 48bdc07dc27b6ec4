"""Training, scoring and search (EVL1-7, EVL10-12, SNK2-3).

The model is MLlib's multinomial logistic regression (the reference's linear
layer + cross-entropy). Metrics for all three splits come from one grouped
aggregation over the scored frame. Search loops run Spark jobs only; every
trial lands in a ``trials`` DataFrame.
"""

from __future__ import annotations

import itertools
import math
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       NaiveBayes, RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepforge.functions.stats import qcol
from prepforge.session import stored

FEATURES = "features"
LABEL = "label"
# Fixed value: probabilities are floored before the log in the log-loss.
EPS = 1e-15
#: Pipelines of a random search that run side by side.
MAX_PIPELINES = 6


def assemble(df: DataFrame, feats: list[str], label: str | None = None) -> DataFrame:
    """Feature columns -> one vector (missing -> 0 at the MLlib edge)."""
    filled = df.withColumns({f: F.coalesce(qcol(f).cast("double"), F.lit(0.0)) for f in feats})
    va = VectorAssembler(inputCols=feats, outputCol=FEATURES)
    out = va.transform(filled)
    if label is not None and label != LABEL:
        out = out.withColumn(LABEL, qcol(label).cast("double"))
    return out


def vectors(prepared: DataFrame, feats: list[str], label: str, split_col: str = "split", weight: str | None = None) -> DataFrame:
    """The narrow (split, label, weight, features) of a prepared frame, stored
    once: every pass of every model and grid point reads it instead of
    preparing the rows again."""
    data = assemble(prepared, feats, label)
    return stored(data.select(qcol(split_col).alias("split"), F.col(LABEL), *([qcol(weight).alias("weight")] if weight else []), FEATURES), "vectors")


def train_logreg(train: DataFrame, weight: str | None = None, reg: float = 0.0, max_iter: int = 100,
                 tol: float = 1e-6):
    lr = LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, family="multinomial", standardization=False,
                            regParam=reg, elasticNetParam=0.0, maxIter=max_iter, tol=tol)
    if weight:
        lr = lr.setWeightCol(weight)
    return lr.fit(train)


def split_metrics(scored: DataFrame, split_col: str = "split") -> dict[str, dict[str, float]]:
    """EVL2 + EVL3 for every split in one job: mean cross-entropy and accuracy."""
    p_true = F.element_at(vector_to_array("probability"), F.col(LABEL).cast("int") + 1)
    rows = (scored.groupBy(split_col)
            .agg(F.avg(-F.log(F.greatest(p_true, F.lit(EPS)))).alias("loss"),
                 F.avg((F.col("prediction") == F.col(LABEL)).cast("double")).alias("acc"),
                 F.count(F.lit(1)).alias("n"))
            .collect())
    return {r[split_col]: {"loss": r["loss"], "acc": r["acc"], "n": r["n"]} for r in rows}


@dataclass
class RunResult:
    best_epoch: int
    best_val_loss: float
    best_tr_acc: float
    best_val_acc: float
    best_test_acc: float
    seconds: float

    def as_row(self, **extra) -> dict:
        return {**extra, "best_epoch": self.best_epoch, "best_val_loss": self.best_val_loss,
                "best_tr_acc": self.best_tr_acc, "best_val_acc": self.best_val_acc,
                "best_test_acc": self.best_test_acc, "seconds": self.seconds}


def score_vectors(data: DataFrame, reg: float = 0.0, max_iter: int = 100) -> tuple[object, RunResult]:
    """Train on the train split of ``vectors``, score all splits (EVL1-3, EVL5)."""
    t0 = time.time()
    model = train_logreg(data.filter("split = 'train'"), weight="weight" if "weight" in data.columns else None, reg=reg, max_iter=max_iter)
    m = split_metrics(model.transform(data))
    nan = float("nan")
    res = RunResult(model.summary.totalIterations if model.hasSummary else max_iter,
                    m.get("val", {}).get("loss", nan), m.get("train", {}).get("acc", nan),
                    m.get("val", {}).get("acc", nan), m.get("test", {}).get("acc", nan), time.time() - t0)
    return model, res


def fit_and_score(prepared: DataFrame, feats: list[str], label: str, split_col: str = "split",
                  weight: str | None = None, reg: float = 0.0, max_iter: int = 100) -> tuple[object, RunResult]:
    """``score_vectors`` of a prepared frame."""
    return score_vectors(vectors(prepared, feats, label, split_col, weight), reg, max_iter)


def expand_grid(params: dict) -> list[dict]:
    """EVL6: list-valued entries are the grid (product in key order)."""
    keys = list(params)
    vals = [v if isinstance(v, list) else [v] for v in params.values()]
    return [dict(zip(keys, combo)) for combo in itertools.product(*vals)]


TRIALS_SCHEMA = ("trial long, params string, best_epoch long, best_val_loss double, best_tr_acc double, "
                 "best_val_acc double, best_test_acc double, seconds double, status string")


def _trial(i: int, p: dict, run, skip_failed: bool) -> tuple:
    try:
        r = run(p)
        return (i, str(sorted(p.items())), r.best_epoch, r.best_val_loss, r.best_tr_acc, r.best_val_acc, r.best_test_acc, r.seconds, "ok")
    except Exception as e:  # noqa: BLE001
        if not skip_failed:
            raise
        return (i, str(sorted(p.items())), None, math.inf, None, None, None, None, f"failed: {e}")


def grid_search(spark, run, params: dict, skip_failed: bool = False) -> DataFrame:
    """EVL6: run every grid point. A failure raises, or with ``skip_failed``
    becomes a trial whose status holds the whole message."""
    return spark.createDataFrame([_trial(i, p, run, skip_failed) for i, p in enumerate(expand_grid(params))], TRIALS_SCHEMA)


def random_search(spark, prepare, n: int = 20, grid: dict | None = None, seed: int = 0, skip_failed: bool = False) -> DataFrame:
    """EVL7: ``n`` random pipelines, each with all points of the model's grid.
    ``prepare(seed)`` gives the ``vectors`` of one pipeline; they are made
    once a pipeline. Pipelines are independent, so ``MAX_PIPELINES`` of them
    run side by side, each from a driver thread: their many small jobs wait
    for the driver rather than for executors."""
    def runs(part: list[tuple[int, dict]]) -> list[tuple]:
        made: list[DataFrame] = []

        def run(p: dict) -> RunResult:
            if not made:
                made.append(prepare(p["seed"]))
            return score_vectors(made[0], **{k: v for k, v in p.items() if k != "seed"})[1]

        return [_trial(i, p, run, skip_failed) for i, p in part]

    points = list(enumerate(expand_grid({"seed": list(range(seed, seed + n)), **(grid or {})})))
    parts = [list(x) for _, x in itertools.groupby(points, lambda e: e[1]["seed"])]
    with ThreadPoolExecutor(max_workers=MAX_PIPELINES) as pool:
        begun = [pool.submit(runs, x) for x in parts]
        try:
            rows = [r for x in begun for r in x.result()]
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            raise
    return spark.createDataFrame(rows, TRIALS_SCHEMA)


def best_trial(trials: DataFrame) -> DataFrame:
    """Lowest validation loss (ties: lowest trial id)."""
    return trials.filter(F.col("status") == "ok").agg(
        F.min_by(F.struct(*trials.columns), F.struct("best_val_loss", "trial")).alias("b")).select("b.*")


def leaderboard(prepared: DataFrame, feats: list[str], label: str, n_classes: int, split_col: str = "split",
                seed: int = 0) -> DataFrame:
    """EVL10 + EVL12: several MLlib models fitted on train+val, scored on test."""
    data = vectors(prepared, feats, label, split_col)
    fit_rows = data.filter(F.col("split").isin("train", "val"))
    test = data.filter(F.col("split") == "test")
    p = len(feats)
    models = {
        "logistic_regression": LogisticRegression(family="multinomial", standardization=False, maxIter=100),
        "random_forest": RandomForestClassifier(numTrees=50, seed=seed),
        "decision_tree": DecisionTreeClassifier(seed=seed),
        "naive_bayes": NaiveBayes(modelType="gaussian"),
        "two_layer_mlp": MultilayerPerceptronClassifier(layers=[p, max(4, 2 * p), n_classes], seed=seed, maxIter=200),
    }
    rows = []
    for name, est in models.items():
        t0 = time.time()
        m = est.fit(fit_rows)
        acc = (m.transform(test).agg(F.avg((F.col("prediction") == F.col(LABEL)).cast("double"))).collect()[0][0])
        rows.append((name, float(acc), time.time() - t0))
    lb = prepared.sparkSession.createDataFrame(rows, "model string, accuracy double, fit_seconds double")
    return lb.orderBy(F.desc("accuracy"), "model")


def comparison(base: dict, new: dict, dataset: str, method: str) -> dict:
    """EVL11: original vs re-evaluated accuracy."""
    return {"dataset": dataset, "method": method, "original_test_acc": base["best_test_acc"],
            "new_test_acc": new["accuracy"], "improvement": new["accuracy"] - base["best_test_acc"]}
