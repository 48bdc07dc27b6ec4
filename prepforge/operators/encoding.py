"""Categorical encoders (ENC1-7).

Vocabularies come from one exploded ``groupBy`` over all columns. Frequency,
count, ordinal and binary encoders keep theirs as a stored (category, number)
table, whatever its size, and apply it with a left join on the category: Spark
broadcasts the table or shuffles by its bytes, and splits hot categories with
AQE's skew join. NULL needs no table: its number is a parameter. One-hot
makes a column per category, so its vocabulary is bounded by the width; its
sparse form keeps a stored table as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepforge.functions.stats import categorical_cols, qcol, value_counts
from prepforge.operators.base import Fitted, PrepOp, register
from prepforge.session import stored

# Fixed values of the ordinal encoder.
UNSEEN_CODE = -1
MISSING_CODE = -2
NULL_NAME = "nan"   # name suffix of the missing category's one-hot column


def _vocab(df: DataFrame, cols: list[str], keep_null: bool, key: str | None = None):
    """{col: [(value, count, first_key), ...]} sorted by value, NULL last."""
    vc = value_counts(df, cols, key=key, keep_null=keep_null).collect()
    out = {c: [] for c in cols}
    for r in vc:
        v = None if r["isnull"] else r["s"]
        out[r["name"]].append((v, r["cnt"], r["first_key"] if key else None))
    for c in out:
        out[c].sort(key=lambda t: (t[0] is None, t[0] or ""))
    return out


def onehot_names(vocab: dict[str, list]) -> dict[tuple[str, str | None], str]:
    """A column name for each (column, category): ``column_category``, with
    ``nan`` for the missing one; a name already given gets ``__1``, ``__2``..."""
    names: dict = {}
    taken: set[str] = set()
    for c, values in vocab.items():
        for v in values:
            name = base = f"{c}_{NULL_NAME if v is None else v}"
            n = 0
            while name in taken:
                n += 1
                name = f"{base}__{n}"
            taken.add(name)
            names[c, v] = name
    return names


class OneHotFitted(Fitted):
    def _names(self):
        named = onehot_names({c: self.params["vocab"][c] for c in self.cols})
        return [(c, v, name) for (c, v), name in named.items()]

    def exprs(self):
        ex = {}
        for c, v, name in self._names():
            cond = qcol(c).isNull() if v is None else (qcol(c) == F.lit(v))
            ex[name] = F.coalesce(cond, F.lit(False)).cast("double")
        return ex

    def dropped(self):
        return list(self.cols)

    def out_cols(self, cols):
        new = [n for _, _, n in self._names()]
        return [c for c in cols if c not in self.cols] + new

    def groups(self) -> dict[str, list[str]]:
        g = {}
        for c, _, n in self._names():
            g.setdefault(c, []).append(n)
        return g


class MapFitted(Fitted):
    """Category -> number (frequency, count, ordinal): ``_tables`` has a
    DataFrame (k, v) for each column, ``nulls`` the number of the missing
    category; categories without an entry get ``default``."""

    def transform(self, df: DataFrame) -> DataFrame:
        for c in self.cols:
            table = self.params["_tables"][c].select(F.col("k").alias("_lk"), F.col("v").alias("_lv"))
            known = F.coalesce(F.col("_lv"), F.lit(float(self.params["default"])))
            value = F.when(qcol(c).isNull(), F.lit(float(self.params["nulls"][c]))).otherwise(known)
            df = df.join(table, qcol(c).cast("string") == F.col("_lk"), "left").withColumn(c, value).drop("_lk", "_lv")
        return df

    def renamed(self, mapping: dict[str, str]) -> "MapFitted":
        clone = super().renamed(mapping)
        clone.params["_tables"] = {mapping.get(c, c): t for c, t in self.params["_tables"].items()}
        return clone


class BinaryFitted(MapFitted):
    def transform(self, df: DataFrame) -> DataFrame:
        df = super().transform(df)
        ex = {}
        for c in self.cols:
            nb = self.params["bits"][c]
            code = qcol(c).cast("long")
            for j in range(nb):
                ex[f"{c}_{j}"] = F.when(code > 0, F.shiftright(code, nb - 1 - j).bitwiseAND(1)).otherwise(0).cast("double")
        return df.withColumns(ex).drop(*self.cols)

    def out_cols(self, cols):
        new = [f"{c}_{j}" for c in self.cols for j in range(self.params["bits"][c])]
        return [c for c in cols if c not in self.cols] + new


class SparseOneHotFitted(MapFitted):
    """One sparse vector a column instead of a column a category: slots in
    category order, the missing category (if the fit had one) last; a category
    that the fit had not is the zero vector. The categories stay in the stored
    table, so their number is bounded by neither plan nor driver."""

    def transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import OneHotEncoder
        sizes = self.params["sizes"]
        out = super().transform(df)
        places = {c: f"_slot_{i}" for i, c in enumerate(self.cols)}
        # the table counts from 1; what has no slot goes to the one that is left out
        out = out.withColumns({s: F.when(qcol(c) >= 1, qcol(c) - 1).otherwise(F.lit(float(sizes[c]))) for c, s in places.items()}).drop(*self.cols)
        encoder = OneHotEncoder(inputCols=list(places.values()), outputCols=list(self.cols), handleInvalid="keep", dropLast=True)
        widest = df.sparkSession.createDataFrame([tuple(float(sizes[c] - 1) for c in self.cols)], list(places.values()))
        return encoder.fit(widest).transform(out).drop(*places.values())


@register("encoding", "onehot", "onehot_sparse", "frequency", "count", "ordinal", "binary", "none")
class Encode(PrepOp):
    stage = "encoding"

    def fit(self, df: DataFrame, cols: list[str], label: str | None = None) -> Fitted:
        m = self.method
        cols = categorical_cols(df, cols)
        if m == "none" or not cols:
            return Fitted("encode.none", cols)
        if m == "onehot":
            voc = _vocab(df, cols, keep_null=True)
            return OneHotFitted("encode.onehot", cols, {"vocab": {c: [v for v, _, _ in voc[c]] for c in cols}})
        if m in ("frequency", "count", "ordinal", "binary", "onehot_sparse"):
            return _table_encoder(df, cols, m, self.kw.get("key"))
        raise ValueError(f"unknown encoding {m}")


def _table_encoder(df: DataFrame, cols: list[str], m: str, key: str | None) -> Fitted:
    """The vocabularies of all columns as one stored table (name, k, v). Only
    two counts a column reach the driver. Ordinal codes follow the first key
    (without a key the category), by positions over all columns together."""
    from prepforge.plans.catalog import global_positions
    counts = stored(value_counts(df, cols, key=key, keep_null=True), "vocabulary")
    sizes = {r["name"]: r for r in counts.groupBy("name").agg(
        F.count_if(~F.col("isnull")).alias("known"), F.sum("cnt").alias("n"), F.sum(F.when(F.col("isnull"), F.col("cnt"))).alias("missing")).collect()}
    known = counts.where(~F.col("isnull"))
    nulls, bits = {}, {}
    if m in ("frequency", "count"):
        for c in cols:
            missing, n = (sizes[c]["missing"] or 0, sizes[c]["n"]) if c in sizes else (0, 1)
            nulls[c] = missing / (n if m == "frequency" else 1)
        total = max((r["n"] for r in sizes.values()), default=1) if m == "frequency" else 1
        table = known.select("name", F.col("s").alias("k"), (F.col("cnt") / F.lit(total)).cast("double").alias("v"))
        default = 0.0
    else:
        before, acc, key = {}, 0, None if m == "onehot_sparse" else key
        for c in sorted(cols):
            n = sizes[c]["known"] if c in sizes else 0
            before[c], nulls[c], bits[c] = acc, MISSING_CODE, max(1, n.bit_length())
            if m == "onehot_sparse" and c in sizes and sizes[c]["missing"]:
                nulls[c] = n + 1
            acc += n
        slots = {c: max(1, max(nulls[c], sizes[c]["known"] if c in sizes else 0)) for c in cols}
        placed, _ = global_positions(known, ["name", *(["first_key"] if key else []), "s"])
        start = F.create_map(*[F.lit(x) for c, n in before.items() for x in (c, n)])
        table = placed.select("name", F.col("s").alias("k"), (F.col("_pos") - start[F.col("name")] + 1).cast("double").alias("v"))
        default = UNSEEN_CODE
    table = stored(table, "encoder")
    tables = {c: table.where(F.col("name") == c).select("k", "v") for c in cols}
    cls = {"binary": BinaryFitted, "onehot_sparse": SparseOneHotFitted}.get(m, MapFitted)
    more = {"sizes": slots} if m == "onehot_sparse" else {}
    return cls(f"encode.{m}", cols, {"nulls": nulls, "default": default, "bits": bits, **more, "_tables": tables})


def union_vocab(df: DataFrame, variants: dict[str, list[str]]) -> dict[str, list]:
    """ENC2: one vocabulary per source column over the union of its variant
    columns (e.g. every imputed alternative), so all variants share a width.
    All sources in one distinct job."""
    parts = [df.select(F.lit(src).alias("src"), F.explode(F.array(*[qcol(v).cast("string") for v in vs])).alias("v"))
             for src, vs in variants.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    vocab: dict[str, list] = {src: [] for src in variants}
    for r in u.distinct().collect():
        vocab[r["src"]].append(r["v"])
    for src in vocab:
        vocab[src].sort(key=lambda v: (v is None, v or ""))
    return vocab
