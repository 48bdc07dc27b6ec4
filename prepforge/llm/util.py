"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepforge.session import ensure_checkpoint_dir


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have, in any letter case."""
    have = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in have:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row: the optimizer inlines
    a column used once, into a lambda too, where it would be computed for each
    element."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def store(df: DataFrame, name: str, compression: str = "snappy", group_rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it
    back: later passes prune columns, and a lost executor loses nothing.
    ``group_rows``: most rows of a row group, for rows of some MB (Spark's
    reader holds up to 4096 rows of a group at once, whatever their size)."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    rows = df.write if group_rows is None else df.write.option("parquet.block.row.count.limit", group_rows)
    rows.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
