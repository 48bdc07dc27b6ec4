"""Dataset sources, ingest cleaning and profiling (SRC1-12, PRF1-3, LBL1,
FLT1-3).

A dataset is a DataFrame plus a ``DatasetSpec``. All checks are aggregates
over the distributed table: one stats pass computes every column's statistic.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepforge.functions.stats import agg_row, categorical_cols, is_numeric, numeric_cols, qcol
from prepforge.session import stored

# The tokens pandas.read_csv reads as missing by default
# (public pandas behaviour), in its documented order.
DEFAULT_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Fixed values used by the ingest rules.
MAX_CATEGORIES = 1000          # categorical columns with more distinct values are dropped
REGRESSION_MIN_DISTINCT = 50   # numeric target with more distinct values -> regression
MIN_CLASS_ROWS = 5             # rare-class filter
OUTLIER_Z = 3.0                # profile: |z| > 3 is an outlier cell


@dataclass
class DatasetSpec:
    label: str
    key: str | None = None
    drop: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    na_tokens: list[str] = field(default_factory=lambda: list(DEFAULT_NA_TOKENS))
    missing_value: str | None = None   # the metadata's ``missing_value`` token, honoured

    def tokens(self) -> list[str]:
        t = list(self.na_tokens)
        if self.missing_value is not None and self.missing_value not in t:
            t.append(self.missing_value)
        return t

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_dict(cls, d: dict) -> "DatasetSpec":
        return cls(label=d["label"], key=d.get("key"), drop=list(d.get("drop_variables", d.get("drop", [])) or []),
                   categorical=list(d.get("categorical_variables", d.get("categorical", [])) or []),
                   missing_value=d.get("missing_value"))


def load_spec(spark: SparkSession, path: str) -> DatasetSpec:
    """SRC3: metadata file (one JSON object) read through Spark, so it may
    live on any Hadoop file system."""
    row = spark.read.option("multiLine", True).json(path).collect()[0].asDict(recursive=True)
    return DatasetSpec.from_dict(row)


def null_tokens(df: DataFrame, tokens, cols=None) -> DataFrame:
    """SRC2: map NA tokens to NULL on string columns (before typing), and NaN
    to NULL on floating columns."""
    cols = list(cols or df.columns)
    out = {}
    for c in cols:
        dt = df.schema[c].dataType
        if isinstance(dt, T.StringType):
            out[c] = F.when(qcol(c).isin(list(tokens)), F.lit(None).cast("string")).otherwise(qcol(c))
        elif isinstance(dt, (T.FloatType, T.DoubleType)):
            out[c] = F.when(F.isnan(qcol(c)), F.lit(None).cast(dt)).otherwise(qcol(c))
    return df.withColumns(out) if out else df


def infer_types(df: DataFrame, keep_string=()) -> DataFrame:
    """Cast string columns whose every non-missing value parses as a number
    to double (one stats pass; ``try_cast`` so ANSI mode never raises)."""
    cands = [c for c in df.columns if isinstance(df.schema[c].dataType, T.StringType) and c not in keep_string]
    if not cands:
        return df
    named = {}
    for i, c in enumerate(cands):
        named[f"n{i}"] = F.count(qcol(c))
        named[f"p{i}"] = F.count(F.expr(f"try_cast(`{c}` AS DOUBLE)"))
    row = agg_row(df, named)
    to_num = [c for i, c in enumerate(cands) if row[f"n{i}"] > 0 and row[f"n{i}"] == row[f"p{i}"]]
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in to_num}) if to_num else df


def load_csv(spark: SparkSession, path: str, spec: DatasetSpec) -> DataFrame:
    """SRC1 + SRC2 + SRC4 + SRC5: header CSV read as strings, NA tokens to
    NULL, listed columns dropped, types inferred, listed categoricals kept
    as strings."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    df = df.drop(*[c for c in spec.drop if c in df.columns])
    df = null_tokens(df, spec.tokens())
    return infer_types(df, keep_string=set(spec.categorical))


def cast_categorical(df: DataFrame, cols) -> DataFrame:
    """SRC5/SRC7: listed columns to string; missing stays NULL (never 'nan')."""
    return df.withColumns({c: qcol(c).cast("string") for c in cols if c in df.columns})


def drop_all_missing(df: DataFrame, cols=None, where=None) -> tuple[DataFrame, list[str]]:
    """SRC8 / FLT2: drop columns with no value (optionally counted on a
    subset, e.g. the train split) from the whole frame."""
    cols = list(cols or df.columns)
    src = df.filter(where) if where is not None else df
    row = agg_row(src, {f"n{i}": F.count(qcol(c)) for i, c in enumerate(cols)})
    dead = [c for i, c in enumerate(cols) if row[f"n{i}"] == 0]
    return df.drop(*dead), dead


def large_categoricals(df: DataFrame, cols, limit: int = MAX_CATEGORIES) -> list[str]:
    """FLT1: categorical columns with more than ``limit`` distinct non-missing
    values. HyperLogLog for all columns in one pass; exact recount only for
    columns whose estimate is near the limit."""
    cols = categorical_cols(df, cols)
    if not cols:
        return []
    row = agg_row(df, {f"d{i}": F.approx_count_distinct(qcol(c)) for i, c in enumerate(cols)})
    big, near = [], []
    for i, c in enumerate(cols):
        est = row[f"d{i}"]
        if est > limit * 1.3:       # ~5% relative error: 6 standard errors away
            big.append(c)
        elif est > limit * 0.7:
            near.append(c)
    for c in near:
        if df.select(qcol(c)).filter(qcol(c).isNotNull()).distinct().count() > limit:
            big.append(c)
    return [c for c in cols if c in big]


def missing_flags(df: DataFrame, cols) -> dict[str, bool]:
    """FLT3: does each column hold a missing value anywhere."""
    row = agg_row(df, {f"m{i}": F.max(qcol(c).isNull().cast("int")) for i, c in enumerate(cols)})
    return {c: bool(row[f"m{i}"]) for i, c in enumerate(cols)}


def drop_missing_label(df: DataFrame, label: str) -> DataFrame:
    """SRC9."""
    return df.filter(qcol(label).isNotNull())


def detect_task_type(df: DataFrame, label: str) -> str:
    """SRC10: numeric target with more than 50 distinct values is regression."""
    if not is_numeric(df, label):
        return "classification"
    n = df.select(qcol(label)).filter(qcol(label).isNotNull()).distinct().limit(REGRESSION_MIN_DISTINCT + 1).count()
    return "regression" if n > REGRESSION_MIN_DISTINCT else "classification"


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(qcol(label).alias(label)).agg(F.count(F.lit(1)).alias("n_rows"))


def rare_class_filter(df: DataFrame, label: str, min_rows: int = MIN_CLASS_ROWS) -> DataFrame:
    """SRC11: keep rows of classes with at least ``min_rows`` rows. The class
    table joins with a left-semi join; Spark broadcasts it if its bytes allow."""
    keep = class_counts(df, label).filter(F.col("n_rows") >= min_rows).select(label)
    return df.join(keep, on=label, how="left_semi")


def label_table(df: DataFrame, label: str) -> DataFrame:
    """LBL1: sorted distinct labels -> 0..K-1, stored; positions come from
    range slices, so a label with many values needs no single task."""
    from prepforge.plans.catalog import global_positions
    d = df.select(qcol(label).alias("label_value")).filter(F.col("label_value").isNotNull()).distinct()
    placed, _ = global_positions(d, ["label_value"])
    return stored(placed.select("label_value", F.col("_pos").cast("int").alias("label_index")), "labels")


def encode_label(df: DataFrame, label: str, out: str = "label") -> DataFrame:
    lt = label_table(df, label)
    j = df.join(lt, qcol(label) == F.col("label_value"), "left")
    j = j.drop("label_value")
    if out == label:
        return j.drop(label).withColumnRenamed("label_index", out)
    return j.withColumnRenamed("label_index", out)


def load_data(spark: SparkSession, folder: str) -> tuple[DataFrame, DatasetSpec, list[str]]:
    """SRC6: the table of a dataset folder (``data`` with header, ``info``),
    its spec, and its feature columns (all but label and key)."""
    spec = load_spec(spark, f"{folder}/info")
    df = load_csv(spark, f"{folder}/data", spec)
    return df, spec, [c for c in df.columns if c not in (spec.label, spec.key)]


@dataclass
class BuiltData:
    """SPL2, the fitted steps from a table to training input: label codes,
    columns with too many categories (FLT1), columns without a value in train
    (FLT2) and which of the rest have gaps anywhere (FLT3)."""

    label: str
    key: str
    features: list[str]
    large: list[str]
    empty: list[str]
    gaps: dict[str, bool]
    labels: DataFrame

    def transform(self, df: DataFrame) -> DataFrame:
        """The same steps on other rows: key, label code (NULL for a label
        that was not there), kept features, and ``split`` if there is one."""
        j = df.join(self.labels, qcol(self.label) == F.col("label_value"), "left")
        keep = [self.key, *self.features, *[c for c in df.columns if c == "split"]]
        return j.select(*[qcol(c) for c in keep], F.col("label_index").alias("label"))


def build_data(df: DataFrame, label: str, key: str, features: list[str] | None = None, seed: int = 1) -> tuple[BuiltData, DataFrame]:
    """SPL2: label codes, FLT1 over the whole table, splits (SPL1), FLT2 by the
    train rows, FLT3; in this order. Returns the fitted steps and the table."""
    from prepforge.operators.split import tag_split
    features = features or [c for c in df.columns if c not in (label, key)]
    large = large_categoricals(df, features)
    left = [c for c in features if c not in large]
    tagged = tag_split(df, key, seed=seed)
    _, empty = drop_all_missing(tagged.select(*[qcol(c) for c in [*left, "split"]]), left, where=F.col("split") == "train")
    kept = [c for c in left if c not in empty]
    built = BuiltData(label, key, kept, large, empty, missing_flags(tagged, kept) if kept else {}, label_table(df, label))
    return built, built.transform(tagged)


def profile(df: DataFrame, label: str, name: str = "", dataset_id: int | None = None,
            task_type: str | None = None) -> DataFrame:
    """PRF1-3: one-row dataset card (missing cells, outlier rows, sizes)."""
    cols = df.columns
    feats = [c for c in cols if c != label]
    nums = numeric_cols(df, feats)
    named = {"n": F.count(F.lit(1))}
    for i, c in enumerate(cols):
        named[f"m{i}"] = F.sum(qcol(c).isNull().cast("long"))
    for i, c in enumerate(nums):
        named[f"a{i}"] = F.avg(qcol(c))
        named[f"s{i}"] = F.stddev_pop(qcol(c))
    if task_type is None:
        task_type = detect_task_type(df, label)
    named["k"] = F.count_distinct(qcol(label))
    row = agg_row(df, named)
    n = row["n"]
    miss = sum(row[f"m{i}"] or 0 for i in range(len(cols)))
    conds = []
    for i, c in enumerate(nums):
        m, s = row[f"a{i}"], row[f"s{i}"]
        if s is not None and s > 0:
            conds.append(F.coalesce(F.abs((qcol(c) - F.lit(m)) / F.lit(s)) > OUTLIER_Z, F.lit(False)))
    n_out = 0
    if conds:
        any_out = conds[0]
        for e in conds[1:]:
            any_out = any_out | e
        n_out = df.filter(any_out).count()
    card = {
        "label": label, "dataset_name": name, "task_type": task_type, "openml_id": dataset_id,
        "num_samples": n, "num_features": len(cols) - 1,
        "num_classes": row["k"] if task_type == "classification" else None,
        "num_missing_values": miss,
        "missing_percentage": round(100.0 * miss / (n * len(cols)), 2) if n else 0.0,
        "num_outlier_samples": n_out,
        "outlier_percentage": round(100.0 * n_out / n, 2) if n else 0.0,
    }
    schema = ("label string, dataset_name string, task_type string, openml_id long, num_samples long, "
              "num_features long, num_classes long, num_missing_values long, missing_percentage double, "
              "num_outlier_samples long, outlier_percentage double")
    return df.sparkSession.createDataFrame([card], schema=schema)


def ingest_clean(df: DataFrame, label: str, key: str, max_samples: int | None = None, seed: int = 42):
    """SRC7-12 in order; returns (frame, task_type). Rows are sampled (SRC12)
    only where ``max_samples`` is given."""
    from prepforge.operators.split import bounded_sample
    df = cast_categorical(df, [c for c in categorical_cols(df, df.columns) if c != label])
    df, _ = drop_all_missing(df, [c for c in df.columns if c not in (label, key)])
    df = drop_missing_label(df, label)
    task = detect_task_type(df, label)
    if task == "classification":
        df = rare_class_filter(df, label)
    if max_samples is not None:
        df = bounded_sample(df, key, max_samples, seed=seed)
    return df, task
