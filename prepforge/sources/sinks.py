"""Sinks (SNK1-5): everything is written through Spark writers, so paths may
be on any Hadoop file system; metadata and results are one-row DataFrames."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepforge.operators.base import Fitted

VOCABULARY = "pos int, name string, k string, v double"


def save_dataset(df: DataFrame, card: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK1: the data plus a one-row dataset card (``info``) beside it."""
    df.write.mode("overwrite").format(fmt).option("header", True).save(f"{path}/data")
    card.coalesce(1).write.mode("overwrite").json(f"{path}/info")


def save_result(spark: SparkSession, params: dict, result: dict, path: str) -> None:
    """SNK2: parameters and result record as one-row JSON tables."""
    spark.createDataFrame([{k: json.dumps(v) if isinstance(v, (list, dict)) else v for k, v in params.items()}]) \
        .coalesce(1).write.mode("overwrite").json(f"{path}/params")
    spark.createDataFrame([result]).coalesce(1).write.mode("overwrite").json(f"{path}/result")


def save_trials(trials: DataFrame, path: str) -> None:
    """SNK3: one row per trial."""
    trials.write.mode("overwrite").parquet(path)


def space_table(spark: SparkSession, space) -> DataFrame:
    """SNK4: (stage, option) rows of a search space."""
    rows = [(k, st.name, "numerical" if st.cat_options else "all", m) for k, st in enumerate(space)
            for _, m, _ in st.options]
    rows += [(0, space[0].name, "categorical", m) for _, m, _ in space[0].cat_options]
    return spark.createDataFrame(rows, "stage int, name string, input string, option string")


def save_model(spark: SparkSession, steps: list[tuple[str, Fitted]], path: str) -> None:
    """SNK5 (write side): the fitted steps as JSON rows, the encoders'
    vocabularies as a table beside them. Steps whose state is rows or a
    trained model (kNN, MICE, tree and EM imputation, LOF, isolation forest)
    are refused here, not at reload."""
    for step, f in steps:
        if not _saves(f):
            raise TypeError(f"{step}: a fitted {f.op} can't be saved as JSON")
    rows = [(i, s, f.to_json()) for i, (s, f) in enumerate(steps)]
    spark.createDataFrame(rows, "pos int, step string, fitted string").coalesce(1).write.mode("overwrite").parquet(f"{path}/steps")
    words = spark.createDataFrame([], VOCABULARY)
    for i, (_, f) in enumerate(steps):
        for c, table in (f.params.get("_tables") or {}).items():
            words = words.unionAll(table.select(F.lit(i).alias("pos"), F.lit(c).alias("name"), "k", "v"))
    words.write.mode("overwrite").parquet(f"{path}/vocabulary")


def _saves(f: Fitted) -> bool:
    from prepforge.operators import discretize, encoding, imputation, outliers, reduction, scaling, selection
    plain = (Fitted, imputation.FillFitted, scaling.ScaleFitted, outliers.RepairFitted, outliers.RowFilterFitted, discretize.BinFitted,
             selection.SelectFitted, reduction.ProjectFitted, encoding.OneHotFitted, encoding.SparseOneHotFitted, encoding.BinaryFitted, encoding.MapFitted)
    return type(f) in plain and not any(k.startswith("_") and k != "_tables" and v for k, v in f.params.items())


def load_model(spark: SparkSession, path: str) -> list[tuple[str, Fitted]]:
    """SNK5 (read side): rebuild the fitted steps (projection operators)."""
    from prepforge.operators import discretize, encoding, imputation, outliers, reduction, scaling, selection
    kinds = {
        "impute": imputation.FillFitted, "scale": scaling.ScaleFitted, "repair": outliers.RepairFitted,
        "remove": outliers.RowFilterFitted, "bin": discretize.BinFitted, "select": selection.SelectFitted,
        "reduce": reduction.ProjectFitted,
    }
    out = []
    words = spark.read.schema(VOCABULARY).parquet(f"{path}/vocabulary")
    for r in spark.read.parquet(f"{path}/steps").orderBy("pos").collect():
        d = json.loads(r["fitted"])
        op = d["op"]
        if op == "encode.onehot":
            cls = encoding.OneHotFitted
        elif op == "encode.onehot_sparse":
            cls = encoding.SparseOneHotFitted
        elif op in ("encode.binary",):
            cls = encoding.BinaryFitted
        elif op.startswith("encode.") and op != "encode.none":
            cls = encoding.MapFitted
        else:
            cls = kinds.get(op.split(".")[0], Fitted)
            if op.endswith(".none") or op.endswith(".identity"):
                cls = Fitted if op.split(".")[0] not in ("impute", "remove", "select") else cls
        if issubclass(cls, encoding.MapFitted):
            d["params"]["_tables"] = {c: words.where((F.col("pos") == r["pos"]) & (F.col("name") == c)).select("k", "v") for c in d["cols"]}
        out.append((r["step"], cls(op, d["cols"], d["params"])))
    return out


# ---------------------------------------------------------------- searched pipelines

def _classes() -> dict[str, type]:
    """All kinds of fitted operators by name."""
    from prepforge.operators import discretize, encoding, iforest, imputation, model_impute, neighbors, outliers, reduction, scaling, selection  # noqa: F401

    def below(c: type) -> list[type]:
        return [c, *[x for s in c.__subclasses__() for x in below(s)]]
    return {c.__name__: c for c in below(Fitted)}


def _write_fitted(f: Fitted, path: str) -> str:
    """A fitted operator as JSON; tables and trees that it holds are written
    below ``path`` and named in it."""
    from prepforge.operators.model_impute import TreeChainFitted
    plain, tables = {}, []
    for k, v in f.params.items():
        if isinstance(v, DataFrame):
            v.write.mode("overwrite").parquet(f"{path}/{k}")
            tables.append(k)
        elif not (isinstance(f, TreeChainFitted) and k == "rounds"):
            plain[k] = v
    if isinstance(f, TreeChainFitted):
        for i, r in enumerate(f.params["rounds"]):
            for j, step in enumerate(r):
                step["_model"].write().overwrite().save(f"{path}/tree-{i}-{j}")
        plain["rounds"] = [[{k: v for k, v in step.items() if k != "_model"} for step in r] for r in f.params["rounds"]]
    return json.dumps({"kind": type(f).__name__, "op": f.op, "cols": f.cols, "params": plain, "tables": tables}, default=float)


def _read_fitted(spark: SparkSession, text: str, path: str) -> Fitted:
    from pyspark.ml.regression import RandomForestRegressionModel
    d = json.loads(text)
    f = _classes()[d["kind"]](d["op"], d["cols"], d["params"])
    f.params |= {k: spark.read.parquet(f"{path}/{k}") for k in d["tables"]}
    if d["kind"] == "TreeChainFitted":
        for i, r in enumerate(f.params["rounds"]):
            for j, step in enumerate(r):
                step["_model"] = RandomForestRegressionModel.load(f"{path}/tree-{i}-{j}")
    return f


def save_space_model(spark: SparkSession, model, path: str) -> None:
    """SNK5 for searched pipelines: choices, order and vocabulary as one row;
    a row per fitted option; kNN rows, removed keys and trees as tables beside
    them. Nothing is held by the driver but parameters."""
    p = model.parts
    slots = [("numeric", 0, 0, t, f) for t, f in enumerate(p.numeric)] + [("categorical", 0, 0, t, f) for t, f in enumerate(p.categorical)]
    slots += [("later", pos, k, t, f) for (pos, k), fits in p.later.items() for t, f in enumerate(fits)]
    rows = [(s, pos, k, t, None if f is None else _write_fitted(f, f"{path}/side/{s}-{pos}-{k}-{t}")) for s, pos, k, t, f in slots]
    spark.createDataFrame(rows, "slot string, pos int, stage int, option int, fitted string").coalesce(1).write.mode("overwrite").parquet(f"{path}/options")
    head = json.dumps({"space": p.space, "choices": p.choices, "num": p.num, "cat": p.cat, "key": p.key, "order": p.order, "vocab": p.vocab}, default=float)
    spark.createDataFrame([(head,)], "model string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load_space_model(spark: SparkSession, path: str):
    """The saved pipeline, in any session: the same expressions, rebuilt."""
    from prepforge.plans.space import SpaceParts
    parts = SpaceParts(**json.loads(spark.read.parquet(f"{path}/model").first()["model"]))
    for r in spark.read.parquet(f"{path}/options").orderBy("slot", "pos", "stage", "option").collect():
        where = f"{path}/side/{r['slot']}-{r['pos']}-{r['stage']}-{r['option']}"
        f = None if r["fitted"] is None else _read_fitted(spark, r["fitted"], where)
        (parts.later.setdefault((r["pos"], r["stage"]), []) if r["slot"] == "later" else getattr(parts, r["slot"])).append(f)
    return parts.model()
