"""Missing-value imputation (IMP1-7, IMP12-14). Model-based imputers
(kNN, MICE, tree, EM) live in ``model_impute``.

Statistics are fitted on the frame given to ``fit`` (the train split) with
missing values ignored, and applied everywhere as ``coalesce``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepforge.functions.stats import agg_row, categorical_cols, modes, numeric_cols, qcol, quantiles
from prepforge.operators.base import Fitted, PrepOp, register

# Fill constants of the reference's imputers.
NUM_CONSTANT = 0.0
CAT_CONSTANT = "0"                 # wrapper operator fills 0
CAT_CONSTANT_PREPROCESSOR = "missing"
DUMMY_CATEGORY = "dummy_category"


class FillFitted(Fitted):
    def exprs(self) -> dict[str, Column]:
        out = {}
        for c, v in self.params["fill"].items():
            if v is None:
                continue
            if isinstance(v, str):
                out[c] = F.coalesce(qcol(c).cast("string"), F.lit(v))
            else:
                out[c] = F.coalesce(qcol(c).cast("double"), F.lit(float(v)))
        return out


def numeric_fill(df: DataFrame, cols: list[str], method: str) -> dict[str, object]:
    """Per-column fill value for a numeric strategy."""
    if not cols:
        return {}
    if method == "mean":
        row = agg_row(df, {f"m{i}": F.avg(qcol(c)) for i, c in enumerate(cols)})
        return {c: row[f"m{i}"] for i, c in enumerate(cols)}
    if method == "median":
        return {c: v[0] for c, v in quantiles(df, cols, [0.5]).items()}
    if method == "most_frequent":
        return modes(df, cols)
    if method == "constant":
        return {c: NUM_CONSTANT for c in cols}
    raise ValueError(method)


@register("imputation", "mean", "median", "most_frequent", "constant", "dummy", "none")
class Impute(PrepOp):
    """Mixed imputer. Numeric columns by ``method``; categorical columns by
    ``cat_policy``:

    * ``wrapper`` (default): ``constant`` fills ``'0'``, ``dummy`` fills
      ``'dummy_category'``, everything else uses the most frequent value;
    * ``same``: categorical imputed only for ``most_frequent`` and
      ``constant`` (fill ``'missing'``), otherwise left missing.
    """
    stage = "imputation"

    def fit(self, df: DataFrame, cols: list[str], label: str | None = None) -> Fitted:
        m = self.method
        if m == "none":
            return FillFitted("impute.none", cols, {"fill": {}})
        policy = self.kw.get("cat_policy", "wrapper")
        nums, cats = numeric_cols(df, cols), categorical_cols(df, cols)
        fill: dict[str, object] = {}
        if m != "dummy":   # the dummy category is a categorical-only imputer
            fill.update(numeric_fill(df, nums, m))
        if cats:
            if policy == "same":
                if m == "most_frequent":
                    fill.update(modes(df, cats))
                elif m == "constant":
                    fill.update({c: CAT_CONSTANT_PREPROCESSOR for c in cats})
            elif m == "constant":
                fill.update({c: CAT_CONSTANT for c in cats})
            elif m == "dummy":
                fill.update({c: DUMMY_CATEGORY for c in cats})
            else:
                fill.update(modes(df, cats))
        return FillFitted(f"impute.{m}", cols, {"fill": fill})
