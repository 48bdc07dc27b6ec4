"""Preparation operators. Importing the package fills the operator registry
(PIP3): ``make_op(stage, name)``."""

from prepforge.operators import (  # noqa: F401
    discretize, encoding, imputation, outliers, reduction, scaling, selection,
)
from prepforge.operators.base import REGISTRY, make_op  # noqa: F401

try:  # model-based operators (kNN, LOF, isolation forest, MICE/EM/tree)
    from prepforge.operators import iforest, model_impute, neighbors  # noqa: F401
except ImportError:  # pragma: no cover - modules added incrementally
    pass
