"""Model-based numeric imputation (IMP9-11).

* ``mice``: chained equations with Bayesian ridge regression, fitted from the
  sufficient statistics of the missing patterns (``functions.patterns``). The
  models are linear, so whatever the chain has done so far, a row's completed
  values are an affine map of its observed ones, one map per pattern. The
  Gram matrix of the completed rows follows from the map and the pattern's
  sums, for every column and round, without reading rows; a round reads them
  once to find the largest change of an imputed cell. The evidence
  maximisation is a p x p loop on the driver; the prediction is a linear
  column expression.
* ``dt``: the same chain with a single regression tree per column (MLlib
  random forest with one tree, sqrt feature subsets, no bootstrap). Rows with
  nothing missing are written once; a round predicts and writes the others.
* ``em``: Gaussian expectation-maximisation from the same statistics: one
  scan, whatever the number of iterations. Imputation = conditional mean
  given the observed coordinates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepforge.functions.patterns import LOCAL_BYTES, Pattern, Patterns, by_pattern, matrix
from prepforge.functions.stats import agg_row, numeric_cols, qcol
from prepforge.operators.base import Fitted, PrepOp, register
from prepforge.session import stored

# Fixed values of the reference's estimators.
MAX_ROUNDS = 10
TOL = 1e-3
BR_TOL = 1e-3
BR_ITERS = 300
BR_PRIOR = 1e-6
EM_ITERS = 50
EM_TOL = 1e-5


def bayesian_ridge(xtx: np.ndarray, xty: np.ndarray, yty: float, n: float) -> np.ndarray:
    """Bayesian ridge coefficients from centred sufficient statistics
    (evidence maximisation of the noise and weight precisions)."""
    p = xtx.shape[0]
    eig, vec = np.linalg.eigh(xtx)
    eig = np.maximum(eig, 0.0)
    var_y = yty / n if n > 0 else 1.0
    alpha, lam = 1.0 / (var_y + np.finfo(float).eps), 1.0
    coef_old = None
    vty = vec.T @ xty
    coef = np.zeros(p)
    for _ in range(BR_ITERS):
        coef = vec @ (vty / (eig + lam / alpha))
        rmse = max(yty - 2.0 * coef @ xty + coef @ xtx @ coef, 0.0)
        gamma = float(np.sum(alpha * eig / (lam + alpha * eig)))
        lam = (gamma + 2 * BR_PRIOR) / (float(coef @ coef) + 2 * BR_PRIOR)
        alpha = (n - gamma + 2 * BR_PRIOR) / (rmse + 2 * BR_PRIOR)
        if coef_old is not None and np.sum(np.abs(coef_old - coef)) < BR_TOL:
            break
        coef_old = coef
    return vec @ (vty / (eig + lam / alpha))


class ChainFitted(Fitted):
    """Replays the fitted chain: initial mean fill, then every (round,
    column) model in order, only on cells missing in the input."""

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.params
        cols = self.cols
        miss = {c: f"_miss_{i}" for i, c in enumerate(cols)}
        out = df.withColumns({miss[c]: qcol(c).isNull() for c in cols})
        out = out.withColumns({c: F.coalesce(qcol(c).cast("double"), F.lit(p["means"][c])) for c in cols})
        for rnd in p["rounds"]:
            for step in rnd:
                c = step["col"]
                out = out.withColumn(c, F.when(F.col(miss[c]), self._predict(step)).otherwise(qcol(c)))
        return out.drop(*miss.values())

    @staticmethod
    def _predict(step):
        e = F.lit(step["intercept"])
        for c, w in zip(step["inputs"], step["coef"]):
            e = e + qcol(c) * F.lit(w)
        return e


#: A fitted link of the chain: target, intercept and one coefficient per column
#: (0 for the target), all for values less the column means.
Link = tuple[int, float, np.ndarray]


def completed(miss: np.ndarray, links: list[Link], start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The map (b, a) of a pattern after some links: completed values are
    ``b @ observed + a``, with 0 (the mean) for what is missing at first."""
    b, a = (np.diag((~miss).astype(float)), np.zeros(len(miss))) if start is None else (start[0].copy(), start[1].copy())
    for target, intercept, coef in links:
        if miss[target]:
            b[target], a[target] = coef @ b, coef @ a + intercept
    return b, a


def _completed_sums(x: Pattern, links: list[Link], target: int) -> np.ndarray:
    """Count, sums and cross products of a pattern's completed rows, where the target is observed."""
    miss, n, s, c = x
    p = len(miss)
    if miss[target]:
        return np.zeros(1 + p + p * p)
    b, a = completed(miss, links)
    bs = b @ s
    both = np.outer(a, bs)
    return np.concatenate([[n], n * a + bs, (n * np.outer(a, a) + both + both.T + b @ c @ b.T).ravel()])


def _largest_change(rows: DataFrame, shift: np.ndarray, before: list[Link], after: list[Link]) -> float:
    """The largest change of an imputed cell by the links ``after`` those ``before``."""
    p = len(shift)

    def job(batches):
        worst = 0.0
        for batch in batches:
            x = matrix(batch, p) - shift
            for miss, at in by_pattern(x):
                old = completed(miss, before)
                new = completed(miss, after, old)
                z = np.nan_to_num(x[at])
                worst = max(worst, float(np.abs(z @ (new[0] - old[0]).T + (new[1] - old[1])).max()))
        yield pa.RecordBatch.from_pydict({"d": [worst]})

    return rows.mapInArrow(job, "d double").agg(F.max("d")).first()[0] or 0.0


@register("imputation", "mice", "MICE")
class MiceImpute(PrepOp):
    """Chained equations; rows need no key."""
    stage = "imputation"

    def fit(self, df: DataFrame, cols: list[str], label: str | None = None) -> Fitted:
        cols = numeric_cols(df, cols)
        stats = Patterns(df, cols, int(self.kw.get("local_bytes", LOCAL_BYTES)))
        p = len(cols)
        order = [j for j in sorted(range(p), key=lambda j: (stats.missing[j], j)) if stats.missing[j] > 0]
        links: list[Link] = []
        for _ in range(int(self.kw.get("max_rounds", MAX_ROUNDS)) if order else 0):
            begun = len(links)
            for j in order:
                v = stats.total(lambda x, j=j, links=tuple(links): _completed_sums(x, links, j), 1 + p + p * p)
                n, mu = v[0], v[1:1 + p] / max(v[0], 1.0)
                g = v[1 + p:].reshape(p, p) - n * np.outer(mu, mu)
                rest = [i for i in range(p) if i != j]
                coef = np.zeros(p)
                coef[rest] = bayesian_ridge(g[np.ix_(rest, rest)], g[rest, j], float(g[j, j]), n)
                links.append((j, float(mu[j] - coef @ mu), coef))
            if _largest_change(stats.rows, stats.means, links[:begun], links[begun:]) < TOL * stats.largest.max():
                break
        steps = [{"col": cols[j], "inputs": [c for i, c in enumerate(cols) if i != j], "coef": np.delete(coef, j).tolist(),
                  "intercept": float(a + stats.means[j] - coef @ stats.means)} for j, a, coef in links]
        rounds = [steps[i:i + len(order)] for i in range(0, len(steps), len(order))] if order else []
        return ChainFitted("impute.mice", cols, {"means": dict(zip(cols, stats.means.tolist(), strict=True)), "rounds": rounds})


# ---------------------------------------------------------------- tree chain

class TreeChainFitted(ChainFitted):
    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        p = self.params
        cols = self.cols
        miss = {c: f"_miss_{i}" for i, c in enumerate(cols)}
        out = df.withColumns({miss[c]: qcol(c).isNull() for c in cols})
        out = out.withColumns({c: F.coalesce(qcol(c).cast("double"), F.lit(p["means"][c])) for c in cols})
        if not p["rounds"]:
            return out.drop(*miss.values())
        whole, out = _by_gaps(out, miss)
        for rnd in p["rounds"]:
            for step in rnd:
                c = step["col"]
                va = VectorAssembler(inputCols=step["inputs"], outputCol="_fv")
                scored = step["_model"].setFeaturesCol("_fv").setPredictionCol("_pred").transform(va.transform(out))
                out = scored.withColumn(c, F.when(F.col(miss[c]), F.col("_pred")).otherwise(qcol(c))).drop("_fv", "_pred")
            out = stored(out, "chain")
        return whole.unionByName(out).drop(*miss.values())


def _by_gaps(df: DataFrame, miss: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The stored rows without a missing value, which no link of a chain changes, and the others."""
    df = stored(df, "chain")
    gaps = F.exists(F.array(*[F.col(m) for m in miss.values()]), lambda m: m)
    return df.where(~gaps), df.where(gaps)


def _tree_column(cur: DataFrame, target: str, inputs: list[str], miss_col: str):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor
    va = VectorAssembler(inputCols=inputs, outputCol="_fv")
    obs = va.transform(cur.filter(~F.col(miss_col)))
    rf = RandomForestRegressor(featuresCol="_fv", labelCol=target, predictionCol="_pred", numTrees=1,
                               featureSubsetStrategy="sqrt", bootstrap=False, seed=0, maxDepth=12)
    model = rf.fit(obs)
    step = {"col": target, "inputs": inputs, "_model": model}
    return step, None


@register("imputation", "dt", "DT")
class TreeImpute(PrepOp):
    stage = "imputation"

    def fit(self, df: DataFrame, cols: list[str], label: str | None = None) -> Fitted:
        from pyspark.ml.feature import VectorAssembler
        cols = numeric_cols(df, cols)
        max_rounds = int(self.kw.get("max_rounds", MAX_ROUNDS))
        row = agg_row(df, {**{f"m{i}": F.avg(qcol(c)) for i, c in enumerate(cols)},
                           **{f"n{i}": F.sum(qcol(c).isNull().cast("long")) for i, c in enumerate(cols)}})
        means = {c: row[f"m{i}"] for i, c in enumerate(cols)}
        order = [c for c in sorted(cols, key=lambda c: (row[f"n{cols.index(c)}"], cols.index(c)))
                 if row[f"n{cols.index(c)}"] > 0]
        miss = {c: f"_miss_{i}" for i, c in enumerate(cols)}
        cur = df.select(*[qcol(c).cast("double").alias(c) for c in cols])
        cur = cur.withColumns({miss[c]: qcol(c).isNull() for c in cols})
        cur = cur.withColumns({c: F.coalesce(qcol(c), F.lit(means[c])) for c in cols})
        if not order:
            return TreeChainFitted("impute.dt", cols, {"means": means, "rounds": []})
        whole, cur = _by_gaps(cur, miss)
        rounds = []
        for _ in range(max_rounds):
            steps = []
            for c in order:
                inputs = [x for x in cols if x != c]
                step, _ = _tree_column(whole.unionByName(cur), c, inputs, miss[c])
                steps.append(step)
                va = VectorAssembler(inputCols=inputs, outputCol="_fv")
                scored = step["_model"].transform(va.transform(cur))
                cur = scored.withColumn(c, F.when(F.col(miss[c]), F.col("_pred")).otherwise(qcol(c))).drop("_fv", "_pred")
            cur = stored(cur, "chain")
            rounds.append(steps)
        return TreeChainFitted("impute.dt", cols, {"means": means, "rounds": rounds})


# ---------------------------------------------------------------- EM

def _em_estep(mu: np.ndarray, sigma: np.ndarray, x: np.ndarray):
    """Conditional means of the missing coordinates and the conditional
    covariance contribution, per missing pattern."""
    p = len(mu)
    xhat = x.copy()
    extra = np.zeros((p, p))
    miss = np.isnan(x)
    patterns = {}
    for i, row in enumerate(miss):
        if row.any():
            patterns.setdefault(row.tobytes(), []).append(i)
    for _, idx in patterns.items():
        m = miss[idx[0]]
        o = ~m
        if not o.any():
            xhat[np.ix_(idx, np.nonzero(m)[0])] = mu[m]
            extra[np.ix_(m, m)] += sigma[np.ix_(m, m)] * len(idx)
            continue
        soo = sigma[np.ix_(o, o)]
        smo = sigma[np.ix_(m, o)]
        k = smo @ np.linalg.pinv(soo)
        xo = x[np.ix_(idx, np.nonzero(o)[0])]
        xhat[np.ix_(idx, np.nonzero(m)[0])] = mu[m] + (xo - mu[o]) @ k.T
        extra[np.ix_(m, m)] += (sigma[np.ix_(m, m)] - k @ smo.T) * len(idx)
    return xhat, extra


class EMFitted(Fitted):
    def transform(self, df: DataFrame) -> DataFrame:
        mu = np.asarray(self.params["mu"])
        sigma = np.asarray(self.params["sigma"])
        cols = self.cols

        @F.pandas_udf("array<double>")
        def fill(*series: pd.Series) -> pd.Series:
            x = np.column_stack([s.to_numpy(dtype=float) for s in series])
            if np.isnan(x).any():
                x, _ = _em_estep(mu, sigma, x)
            return pd.Series(list(x))

        # only the imputed columns go through Python; the others keep their types
        values = fill(*[qcol(c).cast("double") for c in cols])
        out = df.withColumn("_em", values)
        return out.withColumns({c: F.col("_em")[j] for j, c in enumerate(cols)}).drop("_em")


def _expected(x: Pattern, mu: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Expected sums and second moments of a pattern's rows, given the observed values."""
    miss, n, s, c = x
    p, seen = len(miss), ~miss
    b, a, rest = np.diag(seen.astype(float)), np.zeros(p), np.zeros((p, p))
    if miss.any():
        k = sigma[np.ix_(miss, seen)] @ np.linalg.pinv(sigma[np.ix_(seen, seen)]) if seen.any() else np.zeros((p, 0))
        b[np.ix_(miss, seen)], a[miss] = k, mu[miss] - k @ mu[seen]
        rest[np.ix_(miss, miss)] = n * (sigma[np.ix_(miss, miss)] - k @ sigma[np.ix_(seen, miss)])
    bs = b @ s
    both = np.outer(a, bs)
    return np.concatenate([[n], n * a + bs, (n * np.outer(a, a) + both + both.T + b @ c @ b.T + rest).ravel()])


@register("imputation", "em", "EM")
class EMImpute(PrepOp):
    stage = "imputation"

    def fit(self, df: DataFrame, cols: list[str], label: str | None = None) -> Fitted:
        cols = numeric_cols(df, cols)
        p = len(cols)
        stats = Patterns(df, cols, int(self.kw.get("local_bytes", LOCAL_BYTES)))
        mu, sigma = np.zeros(p), np.diag(np.where(stats.variances > 0, stats.variances, 1.0))  # values less the means
        for _ in range(int(self.kw.get("max_iter", EM_ITERS))):
            v = stats.total(lambda x, mu=mu, sigma=sigma: _expected(x, mu, sigma), 1 + p + p * p)
            if not v[0]:
                break
            new_mu = v[1:1 + p] / v[0]
            new_sigma = v[1 + p:].reshape(p, p) / v[0] - np.outer(new_mu, new_mu)
            done = np.max(np.abs(new_mu - mu)) < EM_TOL and np.max(np.abs(new_sigma - sigma)) < EM_TOL
            mu, sigma = new_mu, new_sigma
            if done:
                break
        return EMFitted("impute.em", cols, {"mu": (mu + stats.means).tolist(), "sigma": sigma.tolist()})
