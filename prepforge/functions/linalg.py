"""Distributed second moments.

``gram(df, cols, shift)`` returns ``n``, ``sum(x - shift)`` and
``(x - shift)^T (x - shift)`` over the complete rows. Each partition sums its
Arrow batches in numpy (``mapInPandas``), partial results are folded on 64
reducers, and only p*(p+1)/2 + p + 1 numbers reach the driver. Nothing is
collected per row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepforge.functions.stats import qcol

_FOLD = 64


def _packed_len(p: int) -> int:
    return 1 + p + p * (p + 1) // 2


def gram(df: DataFrame, cols: list[str], shift: list[float] | None = None,
         weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    p = len(cols)
    shift_arr = np.zeros(p) if shift is None else np.asarray(shift, dtype=float)
    iu = np.triu_indices(p)
    L = _packed_len(p)
    sel = [qcol(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]
    if weight:
        sel.append(qcol(weight).cast("double").alias("w"))
    # incomplete rows are skipped in numpy, not with a filter: a null filter
    # over many aliased columns makes Catalyst's constraint inference explode
    src = df.select(*sel)

    def partial(it):
        acc = np.zeros(L)
        for pdf in it:
            if len(pdf) == 0:
                continue
            x = pdf[[f"x{i}" for i in range(p)]].to_numpy(dtype=float)
            w = pdf["w"].to_numpy(dtype=float) if weight else np.ones(len(pdf))
            ok = ~np.isnan(x).any(axis=1) & ~np.isnan(w)
            x, w = x[ok] - shift_arr, w[ok]
            acc[0] += w.sum()
            acc[1:1 + p] += (x * w[:, None]).sum(axis=0)
            acc[1 + p:] += ((x * w[:, None]).T @ x)[iu]
        yield pd.DataFrame({"v": [acc.tolist()]})

    def fold(it):
        acc = np.zeros(L)
        for pdf in it:
            for v in pdf["v"]:
                acc += np.asarray(v)
        yield pd.DataFrame({"v": [acc.tolist()]})

    parts = src.mapInPandas(partial, "v array<double>")
    # one partial row per input partition; fold them on a few reducers so
    # the final per-entry sum sees at most _FOLD rows per entry
    n_fold = max(1, min(_FOLD, df.sparkSession.sparkContext.defaultParallelism // 8))
    folded = parts.repartition(n_fold).mapInPandas(fold, "v array<double>")
    rows = (folded.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
            .collect())
    vec = np.zeros(L)
    for r in rows:
        vec[r["i"]] = r["x"]
    n = vec[0]
    s = vec[1:1 + p]
    g = np.zeros((p, p))
    g[iu] = vec[1 + p:]
    g = g + np.triu(g, 1).T
    return n, s, g


def sym_eig_desc(m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Top-k eigenpairs, largest first; each vector's largest-|.| entry made
    positive (our sign convention)."""
    w, v = np.linalg.eigh(m)
    order = np.argsort(-w, kind="stable")[:k]
    w, v = w[order], v[:, order]
    for j in range(v.shape[1]):
        i = np.argmax(np.abs(v[:, j]))
        if v[i, j] < 0:
            v[:, j] = -v[:, j]
    return w, v
