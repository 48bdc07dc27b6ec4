"""Discretisation (DSC1-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepforge.functions.stats import agg_row, numeric_cols, order_stats, profile_numeric, qcol
from prepforge.operators.base import Fitted, PrepOp, register

# Fixed value: guard added to the uniform bin width.
WIDTH_EPS = 1e-12


class BinFitted(Fitted):
    def exprs(self):
        p = self.params
        n = p["n_bins"]
        out = {}
        if p["strategy"] == "uniform":
            for c, (mn, step) in p["edges"].items():
                v = (qcol(c) - F.lit(mn)) / F.lit(step + WIDTH_EPS)
                # bound in double first so the truncating cast can never overflow
                raw = F.least(F.greatest(v, F.lit(-1.0)), F.lit(float(n))).cast("long")
                out[c] = F.when(qcol(c).isNull(), F.lit(None)).otherwise(
                    F.greatest(F.lit(0), F.least(F.lit(n - 1), raw))).cast("double")
        else:
            for c, cuts in p["cuts"].items():
                cnt = F.lit(0)
                for v in cuts:
                    cnt = cnt + (qcol(c) > F.lit(v)).cast("int")
                out[c] = F.when(qcol(c).isNull(), F.lit(None)).otherwise(F.least(F.lit(n - 1), cnt)).cast("double")
        return out


def _parse(method: str) -> tuple[str, int]:
    strat, _, n = method.partition("_")
    return strat, int(n) if n else 5


@register("discretization", "uniform_5", "uniform_10", "uniform_20", "quantile_5", "quantile_10", "quantile_20",
          "identity")
class Discretize(PrepOp):
    """``uniform_<n>`` or ``quantile_<n>`` (any other strategy name is
    quantile, as in the reference)."""
    stage = "discretization"

    def fit(self, df: DataFrame, cols: list[str], label: str | None = None) -> Fitted:
        cols = numeric_cols(df, cols)
        if self.method == "identity" or not cols:
            return Fitted("bin.identity", cols)
        strat, n = _parse(self.method)
        if strat == "uniform":
            row = agg_row(df, {**{f"a{i}": F.min(qcol(c)) for i, c in enumerate(cols)},
                               **{f"b{i}": F.max(qcol(c)) for i, c in enumerate(cols)}})
            edges = {c: (row[f"a{i}"], (row[f"b{i}"] - row[f"a{i}"]) / n) for i, c in enumerate(cols)
                     if row[f"a{i}"] is not None}
            return BinFitted(f"bin.uniform_{n}", cols, {"strategy": "uniform", "n_bins": n, "edges": edges})
        return BinFitted(f"bin.quantile_{n}", cols,
                         {"strategy": "quantile", "n_bins": n, "cuts": quantile_cuts(df, cols, n)})


def quantile_cuts(df: DataFrame, cols: list[str], n_bins: int) -> dict[str, list[float]]:
    """Cut points = sorted values at 0-based positions step-1, 2*step-1, ...
    (< n_rows-1) with ``step = round(n_rows / n_bins)`` (half-even)."""
    exprs = {c: qcol(c) for c in cols}
    prof = profile_numeric(df, exprs)
    ranks = {}
    for c in cols:
        n = prof[c][0]
        step = round(n / n_bins)
        ranks[c] = list(range(step - 1, n - 1, step)) if step > 0 else []
    got = order_stats(df, exprs, ranks, prof)
    return {c: got[c] for c in cols}
