"""Step pipeline (PIP1-2): one operator per step, numeric and categorical
blocks handled separately, steps in a configurable order.

``fit`` runs a handful of aggregation jobs per step on the train rows (each
step's statistics see the previous steps' output); ``PrepModel.transform`` is
the chain of fitted projections, which Catalyst collapses into one codegen
stage, plus the train-only row filter of the outlier step.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepforge.functions.stats import categorical_cols, numeric_cols, qcol
from prepforge.operators.base import Fitted, make_op

# The default step order and its four alternatives.
DEFAULT_ORDER = ["imputation", "scaling", "encoding", "outlier_removal", "feature_selection",
                 "dimensionality_reduction"]
ALT_ORDERS = {
    1: ["imputation", "encoding", "outlier_removal", "scaling", "feature_selection", "dimensionality_reduction"],
    2: ["imputation", "encoding", "outlier_removal", "scaling", "dimensionality_reduction", "feature_selection"],
    3: ["imputation", "encoding", "outlier_removal", "feature_selection", "scaling", "dimensionality_reduction"],
    4: ["imputation", "encoding", "scaling", "outlier_removal", "feature_selection", "dimensionality_reduction"],
}


@dataclass
class PrepModel:
    steps: list[tuple[str, Fitted]]
    input_cols: list[str]
    output_cols: list[str]
    label: str | None = None
    split_col: str | None = None
    meta: dict = field(default_factory=dict)

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        for _, fitted in self.steps:
            df = fitted.transform(df)
        if keep is None:
            return df
        return df.select(*[qcol(c) for c in keep + self.output_cols])

    def describe(self) -> list[dict]:
        return [{"step": s, "op": f.op, "cols": f.cols, "params": f.params} for s, f in self.steps]


class PrepPipeline:
    """``config``: step -> operator name (or (name, kwargs)); missing steps are
    skipped. ``order``: list of steps or an ALT_ORDERS index.
    ``per_feature``: step -> {feature: operator name} (PIP8: each feature its
    own choice; features sharing a choice are fitted together)."""

    def __init__(self, config: dict, order=None, per_feature: dict | None = None, cat_policy: str = "wrapper",
                 cache: bool = False):
        self.config = config
        self.order = ALT_ORDERS[order] if isinstance(order, int) else (order or DEFAULT_ORDER)
        self.per_feature = per_feature or {}
        self.cat_policy = cat_policy
        self.cache = cache

    def _op(self, step: str, name, **extra):
        if isinstance(name, tuple):
            name, kw = name
        else:
            kw = {}
        if step == "imputation":
            kw.setdefault("cat_policy", self.cat_policy)
        return make_op(step, name, **{**kw, **extra})

    def fit(self, df: DataFrame, feature_cols: list[str], label: str | None = None,
            split_col: str | None = None, key: str | None = None) -> PrepModel:
        train = df.filter(F.col(split_col) == "train") if split_col else df
        if self.cache:
            train = train.persist(StorageLevel.MEMORY_AND_DISK)
        num = numeric_cols(df, feature_cols)
        cat = categorical_cols(df, feature_cols)
        cat_encoded = False
        steps: list[tuple[str, Fitted]] = []
        cur = train

        def run(step, cols, **extra):
            nonlocal cur
            choice = self.per_feature.get(step)
            if choice:
                groups: dict = {}
                for c in cols:
                    groups.setdefault(choice.get(c, self.config.get(step, "none")), []).append(c)
                fitted_all = []
                for name, gcols in groups.items():
                    f = self._op(step, name, **extra).fit(cur, gcols, label)
                    fitted_all.append(f)
                    cur = f.transform(cur)
                    steps.append((step, f))
                return fitted_all
            f = self._op(step, self.config[step], **extra).fit(cur, cols, label)
            cur = f.transform(cur)
            steps.append((step, f))
            return [f]

        for step in self.order:
            if step not in self.config and step not in self.per_feature:
                continue
            keyed = {"key": key} if key else {}
            if step == "imputation":
                run(step, num + cat, **keyed)
            elif step == "scaling":
                run(step, num)
            elif step == "encoding":
                for f in run(step, cat, **keyed):
                    new = f.out_cols(cat)
                    if new != cat or f.op != "encode.none":
                        cat = new
                        cat_encoded = f.op != "encode.none"
            elif step == "outlier_removal":
                run(step, num, split_col=split_col, **keyed)
            elif step == "feature_selection":
                cands = num + (cat if cat_encoded else [])
                for f in run(step, cands):
                    num = f.out_cols(num) if hasattr(f, "out_cols") else num
                    if cat_encoded:
                        cat = f.out_cols(cat)
            elif step == "dimensionality_reduction":
                for f in run(step, num):
                    num = f.out_cols(num)
            else:
                raise ValueError(f"unknown step {step}")
        if self.cache:
            train.unpersist()
        return PrepModel(steps, list(feature_cols), num + cat, label, split_col,
                         {"order": self.order, "config": {k: str(v) for k, v in self.config.items()}})
