"""Isolation forest row removal (OUT4).

* sampling: tree ``t`` takes the ``min(256, n)`` rows with the smallest
  ``xxhash64(seed, t, key)`` - a bounded per-tree sample picked with a
  hash-threshold pre-filter and a window partitioned by tree (each group
  holds ~3x256 rows, never the table);
* building: ``groupBy(tree).applyInPandas`` grows each tree in numpy;
* scoring: the node table (trees x <=511 nodes) is shipped inside a
  vectorised pandas UDF; the anomaly score of a row is
  ``2 ** (-mean path length / c(256))``;
* cut: the 5% most anomalous train rows, i.e. score above the exact 95th
  percentile of the train scores.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepforge.functions.stats import numeric_cols, qcol, quantiles
from prepforge.session import stored
from prepforge.operators.base import Fitted, PrepOp, register

# Fixed values of the reference's estimator.
N_TREES = 100
MAX_SAMPLES = 256
CONTAMINATION = 0.05
SEED = 42
EULER = 0.5772156649


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful search in a binary tree."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.RandomState, max_depth: int):
    """Nodes as rows (node, feature, threshold, left, right, size); leaves
    have feature -1."""
    nodes = []

    def build(idx, depth):
        nid = len(nodes)
        nodes.append(None)
        sub = x[idx]
        if depth >= max_depth or len(idx) <= 1:
            nodes[nid] = (nid, -1, 0.0, -1, -1, len(idx))
            return nid
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        live = np.nonzero(hi > lo)[0]
        if len(live) == 0:
            nodes[nid] = (nid, -1, 0.0, -1, -1, len(idx))
            return nid
        f = int(live[rng.randint(len(live))])
        thr = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < thr]
        right = idx[sub[:, f] >= thr]
        li = build(left, depth + 1)
        ri = build(right, depth + 1)
        nodes[nid] = (nid, f, thr, li, ri, len(idx))
        return nid

    build(np.arange(len(x)), 0)
    return nodes


def _path_lengths(x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Vectorised descent of all rows through one tree."""
    cur = np.zeros(len(x), dtype=np.int64)
    depth = np.zeros(len(x))
    feat, thr, left, right, size = (nodes[:, 1].astype(np.int64), nodes[:, 2], nodes[:, 3].astype(np.int64),
                                    nodes[:, 4].astype(np.int64), nodes[:, 5])
    active = feat[cur] >= 0
    while active.any():
        ci = cur[active]
        go_left = x[active, feat[ci]] < thr[ci]
        cur[active] = np.where(go_left, left[ci], right[ci])
        depth[active] += 1
        active = feat[cur] >= 0
    leaf = np.array([c_factor(n) for n in size])  # per node, not per row
    return depth + leaf[cur]


class ForestFitted(Fitted):
    def score(self) -> Column:
        forest = [np.asarray(t, dtype=float) for t in self.params["_trees"]]
        norm = c_factor(self.params["psi"])
        p = len(self.cols)

        @F.pandas_udf(T.DoubleType())
        def anomaly(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float) for c in cols]) if p else np.zeros((len(cols[0]), 0))
            x = np.nan_to_num(x)
            h = np.zeros(len(x))
            for nodes in forest:
                h += _path_lengths(x, nodes)
            return pd.Series(np.power(2.0, -(h / len(forest)) / norm))

        return anomaly(*[qcol(c).cast("double") for c in self.cols])

    def keep(self) -> Column:
        return self.score() <= F.lit(self.params["threshold"])

    def weight(self) -> Column:
        return self.keep().cast("double")

    def transform(self, df: DataFrame) -> DataFrame:
        split_col = self.params.get("split_col")
        k = self.keep()
        if split_col and split_col in df.columns:
            k = (F.col(split_col) != F.lit("train")) | k
        return df.filter(k)


def build_forest(df: DataFrame, key: str, cols: list[str], n_trees: int = N_TREES, max_samples: int = MAX_SAMPLES,
                 seed: int = SEED) -> tuple[list, int]:
    n = df.count()
    psi = min(max_samples, n)
    frac = min(1.0, 3.0 * psi / max(n, 1))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    # per (row, tree) uniform in [0, 1) from a hash; pre-filter, then exact per-tree top-psi
    u = [((F.xxhash64(F.lit(seed), F.lit(t), qcol(key)).bitwiseAND(F.lit((1 << 52) - 1))).cast("double")
          / float(1 << 52)) for t in range(n_trees)]
    picks = F.filter(F.array(*[F.struct(F.lit(t).alias("tree"), u[t].alias("u")) for t in range(n_trees)]),
                     lambda s: s["u"] < F.lit(frac) if frac < 1.0 else F.lit(True))
    xs = [qcol(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]
    cand = df.select(qcol(key).alias("k"), *xs, F.inline(picks))
    w = Window.partitionBy("tree").orderBy("u", "k")
    sample = cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= psi).drop("_r")
    names = [f"x{i}" for i in range(len(cols))]

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = np.nan_to_num(pdf.sort_values(["u", "k"])[names].to_numpy(dtype=float))
        nodes = _grow(x, np.random.RandomState(seed + t), max_depth)
        arr = np.asarray(nodes, dtype=float)
        return pd.DataFrame({"tree": t, "node": arr[:, 0].astype(int), "feature": arr[:, 1].astype(int),
                             "threshold": arr[:, 2], "left": arr[:, 3].astype(int), "right": arr[:, 4].astype(int),
                             "size": arr[:, 5]})

    schema = "tree int, node int, feature int, threshold double, left int, right int, size double"
    rows = sample.groupBy("tree").applyInPandas(grow, schema).collect()   # <= trees x 511 rows
    trees: dict[int, list] = {}
    for r in rows:
        trees.setdefault(r["tree"], []).append((r["node"], r["feature"], r["threshold"], r["left"], r["right"], r["size"]))
    return [sorted(trees[t]) for t in sorted(trees)], psi


@register("outlier_removal", "isolation_forest")
class RemoveIsolationForest(PrepOp):
    stage = "outlier_removal"

    def fit(self, df: DataFrame, cols: list[str], label: str | None = None) -> Fitted:
        key = self.kw.get("key")
        if key is None:
            raise ValueError("isolation forest needs a row key (kw key=...)")
        cols = numeric_cols(df, cols)
        trees, psi = build_forest(df, key, cols, int(self.kw.get("n_trees", N_TREES)),
                                  int(self.kw.get("max_samples", MAX_SAMPLES)), int(self.kw.get("seed", SEED)))
        fitted = ForestFitted("remove.isolation_forest", cols,
                              {"_trees": trees, "psi": psi, "split_col": self.kw.get("split_col"), "threshold": None})
        scored = stored(df.select(fitted.score().alias("s")), "scores")  # the profile and every pass of the cut read them
        thr = quantiles(scored, ["s"], [1.0 - CONTAMINATION])["s"][0]
        fitted.params["threshold"] = thr
        return fitted
