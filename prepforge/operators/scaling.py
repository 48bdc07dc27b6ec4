"""Scaling (SCL1-7, FLT5). One aggregation job per fit; missing values are
ignored in the fit and stay missing in the transform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepforge.functions.stats import agg_row, numeric_cols, qcol, quantiles
from prepforge.operators.base import Fitted, PrepOp, clip, register

# Fixed value: scaled output is clipped to +-1e10.
CLIP_BOUND = 1e10

# aliases of the older operator library
ALIASES = {"ZS": "standard", "MM": "minmax_clip", "MA": "maxabs", "RS": "robust"}


class ScaleFitted(Fitted):
    """``(x - shift) / scale`` per column, optional [0,1] and +-1e10 clips."""

    def exprs(self) -> dict[str, Column]:
        out = {}
        p = self.params
        for c, (shift, scale) in p["affine"].items():
            e = (qcol(c).cast("double") - F.lit(float(shift))) / F.lit(float(scale))
            if p.get("unit_clip"):
                e = clip(e, 0.0, 1.0)
            if p.get("clip", True):
                e = clip(e, -CLIP_BOUND, CLIP_BOUND)
            out[c] = e
        return out


def _nz(v):
    return 1.0 if v is None or v == 0 or v != v else float(v)


@register("scaling", "standard", "minmax", "minmax_clip", "robust", "maxabs", "none", "ZS", "MM", "MA", "RS")
class Scale(PrepOp):
    stage = "scaling"

    def fit(self, df: DataFrame, cols: list[str], label: str | None = None) -> Fitted:
        m = ALIASES.get(self.method, self.method)
        cols = numeric_cols(df, cols)
        if m == "none" or not cols:
            return ScaleFitted("scale.none", cols, {"affine": {}})
        affine = {}
        if m == "standard":
            row = agg_row(df, {**{f"a{i}": F.avg(qcol(c)) for i, c in enumerate(cols)},
                               **{f"s{i}": F.stddev_pop(qcol(c)) for i, c in enumerate(cols)}})
            affine = {c: (row[f"a{i}"] or 0.0, _nz(row[f"s{i}"])) for i, c in enumerate(cols)}
        elif m in ("minmax", "minmax_clip"):
            row = agg_row(df, {**{f"a{i}": F.min(qcol(c)) for i, c in enumerate(cols)},
                               **{f"b{i}": F.max(qcol(c)) for i, c in enumerate(cols)}})
            affine = {c: (row[f"a{i}"] or 0.0, _nz((row[f"b{i}"] or 0.0) - (row[f"a{i}"] or 0.0)))
                      for i, c in enumerate(cols)}
        elif m == "robust":
            q = quantiles(df, cols, [0.25, 0.5, 0.75])
            affine = {c: (q[c][1] or 0.0, _nz(None if q[c][0] is None else q[c][2] - q[c][0])) for c in cols}
        elif m == "maxabs":
            row = agg_row(df, {f"a{i}": F.max(F.abs(qcol(c))) for i, c in enumerate(cols)})
            affine = {c: (0.0, _nz(row[f"a{i}"])) for i, c in enumerate(cols)}
        else:
            raise ValueError(f"unknown scaling {self.method}")
        return ScaleFitted(f"scale.{m}", cols, {"affine": affine, "unit_clip": m == "minmax_clip",
                                               "clip": self.kw.get("clip", True)})


def prenormalize(df: DataFrame, cols: list[str], split_col: str = "split") -> tuple[DataFrame, Fitted]:
    """SCL7: min-max fitted on the train rows, unclipped, numeric only, applied
    to every split; column order kept."""
    train = df.filter(F.col(split_col) == "train")
    fitted = Scale("minmax", clip=False).fit(train, cols)
    return fitted.transform(df), fitted
