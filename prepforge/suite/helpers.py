"""Small shared pieces of the query suite (Spark side and SQL side)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepforge.functions.stats import qcol
from prepforge.operators.split import tag_split

PLACES = 6

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a Spark query (and its DuckDB oracle, when SQL can say it)."""
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Round every floating column (both engines round the same way)."""
    ex = {f.name: F.round(qcol(f.name), places) for f in df.schema.fields
          if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(ex) if ex else df


def split_frame(df: DataFrame, key: str, seed: int = 1) -> DataFrame:
    return tag_split(df, key, seed=seed)


def train_of(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split") == "train")


def fit_apply(df: DataFrame, op, cols, label=None) -> DataFrame:
    fitted = op.fit(train_of(df), cols, label)
    return fitted.transform(df)


def long_form(df: DataFrame, ids: list[str], cols: list[str], name="column_name", value="value") -> DataFrame:
    """Wide -> (ids, column_name, value): used where the output width depends
    on fitted vocabularies, so the oracle can compare without knowing them."""
    return df.unpivot(ids, [qcol(c).cast("double").alias(c) for c in cols], name, value)


def sql_round(expr: str, places: int = PLACES) -> str:
    return f"round({expr}, {places})"
