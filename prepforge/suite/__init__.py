"""Query suite: every operator as a Spark query over the test tables, plus
the equivalent DuckDB SQL where SQL can express it."""

from prepforge.suite import q_models, q_ops, q_plans, q_search, q_sources  # noqa: F401  (registration)
from prepforge.suite.helpers import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
