"""Operator contract.

``PrepOp.fit(df, cols, label=None) -> Fitted`` computes statistics with
distributed aggregates (never by collecting rows); ``Fitted.transform(df)``
is a projection of plain ``Column`` expressions (or a row filter), so a chain
of fitted operators collapses into one whole-stage-codegen projection and
also runs unchanged on a streaming DataFrame. Fitted state is JSON-able.
"""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepforge.functions.stats import qcol

REGISTRY: dict[str, dict[str, type]] = {}


def register(stage: str, *names: str):
    def deco(cls):
        for n in names:
            REGISTRY.setdefault(stage, {})[n] = cls
        return cls
    return deco


def make_op(stage: str, name: str, **kw) -> "PrepOp":
    """PIP3: operator by (stage, name). Unknown names raise."""
    try:
        cls = REGISTRY[stage][name]
    except KeyError as e:
        raise ValueError(f"unknown operator {stage}/{name}") from e
    return cls(name, **kw)


class PrepOp:
    stage = "base"

    def __init__(self, method: str = "none", **kw):
        self.method = method
        self.kw = kw

    def fit(self, df: DataFrame, cols: list[str], label: str | None = None) -> "Fitted":
        raise NotImplementedError

    def __repr__(self):
        return f"{self.stage}:{self.method}"


@dataclass
class Fitted:
    """A fitted operator: replaces ``cols`` by expressions (and may add or
    drop columns). ``row_filter`` marks train-only row removal."""
    op: str
    cols: list[str]
    params: dict = field(default_factory=dict)

    def exprs(self) -> dict[str, Column]:
        return {}

    def dropped(self) -> list[str]:
        return []

    def out_cols(self, cols: list[str]) -> list[str]:
        return cols

    def transform(self, df: DataFrame) -> DataFrame:
        ex = self.exprs()
        if ex:
            df = df.withColumns(ex)
        d = self.dropped()
        return df.drop(*d) if d else df

    def to_json(self) -> str:
        plain = {k: v for k, v in self.params.items() if not k.startswith("_")}
        return json.dumps({"op": self.op, "cols": self.cols, "params": plain}, default=float)

    def renamed(self, mapping: dict[str, str]) -> "Fitted":
        """The same fitted operator reading (and writing) renamed columns:
        column names among the parameters' dict keys and list items are
        mapped. Used to evaluate an operator at shifted inputs."""
        def walk(v):
            if isinstance(v, dict):
                return {mapping.get(k, k) if isinstance(k, str) else k: walk(x) for k, x in v.items()}
            if isinstance(v, list):
                return [mapping.get(x, x) if isinstance(x, str) else walk(x) for x in v]
            return v
        clone = copy.copy(self)
        clone.cols = [mapping.get(c, c) for c in self.cols]
        clone.params = {k: (v if k.startswith("_") else walk(v)) for k, v in self.params.items()}
        return clone


class Identity(Fitted):
    pass


def clip(c: Column, lo: float, hi: float) -> Column:
    """NULL-preserving clip."""
    return F.when(c.isNull(), c).otherwise(F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))


def safe_div(num: Column, den: float | None) -> Column:
    return num / F.lit(1.0 if den is None or den == 0 else den)


__all__ = ["PrepOp", "Fitted", "Identity", "register", "make_op", "REGISTRY", "clip", "safe_div", "qcol"]
