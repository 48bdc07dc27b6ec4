"""Exact k-nearest-neighbour operators: kNN imputation (IMP8) and local
outlier factor (OUT3), and an approximate method beside them (LSH).

Base rows lie in cells around pivots, a bounded sample of them. A cell knows
its radius, so by the triangle inequality no row of it is nearer to a query
than the query's distance to the pivot less the radius. Each query searches
the cell of its nearest pivot first; its k-th distance there then rules out
most other cells, and it is sent to the rest only. Small cells lie together
in groups of at most ``prepforge.knn.blockRows`` rows, larger ones in several
blocks; a query is sent once to a group, with the cells of it that it needs.
Rows are compared in tiles of one block of a group and one slice of the
queries that need it, both of at most that many rows, in numpy, a few hundred
queries at a time. A tile emits its k best per query, after the first cell
only those that are no farther than the k-th known, and a window merges them.
Base rows are copied only where a group has more queries than a slice holds.
Of base rows that coincide only as many are searched as one query may take.

With missing values the distance is no metric. It is never less than the
distance over the columns that are complete everywhere, times
sqrt(p / columns that the query has), so cells are built and ruled out over
those columns. Without any such column there is one cell.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prepforge.functions.stats import agg_row, numeric_cols, qcol
from prepforge.operators.base import Fitted, PrepOp, register
from prepforge.session import conf_int, stored

_SLICE = 512
# Fixed values of the reference's estimators.
KNN_IMPUTE_K = 5
LOF_K = 20
LOF_CUT = 1.5
LOF_EPS = 1e-10
#: Most pivots (their coordinates go to every task).
MAX_PIVOTS = 1024
#: Most cells of a group (bits of a long).
MASK_BITS = 62


def _nan_sq_dist(q: np.ndarray, b: np.ndarray, nan_aware: bool) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances (q x b). NaN-aware form: sum over coordinates
    present in both rows, scaled by p / n_present (NaN-Euclidean)."""
    if not nan_aware:
        d = (q * q).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * q @ b.T
        return np.maximum(d, 0.0), None
    mq, mb = ~np.isnan(q), ~np.isnan(b)
    q0, b0 = np.where(mq, q, 0.0), np.where(mb, b, 0.0)
    d = (q0 * q0) @ mb.T + mq @ (b0 * b0).T - 2.0 * q0 @ b0.T
    npres = mq.astype(float) @ mb.T.astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(npres > 0, np.maximum(d, 0.0) * q.shape[1] / npres, np.inf)
    return d, npres


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(_nan_sq_dist(x, pivots, False)[0])


def _slack(tau):
    """A distance to beat, with room for rounding."""
    return tau * (1 + 1e-9) + 1e-9


def _tile(Q: np.ndarray, qk: np.ndarray, tau: np.ndarray, B: np.ndarray, bk: np.ndarray, k: int, exclude_self: bool, per_column: bool,
          wanted: Callable[[slice], np.ndarray] | None = None) -> pd.DataFrame:
    """The k best base rows of each query (and missing column) of a tile, no
    farther than ``tau``; only the ``wanted`` pairs of a slice of queries."""
    beyond = _slack(tau) ** 2
    border = np.argsort(bk, kind="stable")          # ties -> smaller base key first
    B, bk = B[border], bk[border]
    kept = lambda s: None if wanted is None else wanted(s)[:, border]
    out = [pd.DataFrame({"qk": qk[:0], "j": np.zeros(0, np.int32), "bk": bk[:0], "dist": np.zeros(0), "value": np.zeros(0)})]
    for s in range(0, len(Q) if len(B) else 0, _SLICE):
        Qs, qks = Q[s:s + _SLICE], qk[s:s + _SLICE]
        d, _ = _nan_sq_dist(Qs, B, per_column)
        if (pairs := kept(slice(s, s + _SLICE))) is not None:
            d = np.where(pairs, d, np.inf)
        if exclude_self:
            d = np.where(qks[:, None] == bk[None, :], np.inf, d)
        targets = [(j, ~np.isnan(B[:, j]), np.isnan(Qs[:, j])) for j in range(Q.shape[1])] if per_column else \
            [(-1, np.ones(len(B), bool), np.ones(len(Qs), bool))]
        for j, donor_ok, need in targets:
            rows = np.nonzero(need)[0]
            if len(rows) == 0:
                continue
            dj = np.where(donor_ok[None, :], d[rows], np.inf)
            kk = min(k, dj.shape[1])
            # the k smallest with their ties, then those in order
            edge = np.minimum(np.partition(dj, kk - 1, axis=1)[:, kk - 1:kk], beyond[s:s + _SLICE][rows, None])
            r, c = np.nonzero((dj <= edge) & np.isfinite(dj))
            dist = dj[r, c]
            order = np.lexsort((c, dist, r))
            r, c, dist = r[order], c[order], dist[order]
            first = np.searchsorted(r, np.arange(len(rows)))
            best = np.arange(len(r)) - first[r] < kk
            r, c, dist = rows[r[best]], c[best], dist[best]
            out.append(pd.DataFrame({"qk": qks[r], "j": np.full(len(c), j, dtype=np.int32), "bk": bk[c], "dist": np.sqrt(dist), "value": B[c, j] if j >= 0 else np.zeros(len(c))}))
    return pd.concat(out, ignore_index=True)


class CellIndex:
    """Base rows by nearest pivot, with what rules a cell out."""

    def __init__(self, base: DataFrame, n: int, metric: list[int], p: int, block_rows: int) -> None:
        """``base``: bk, x (array of p values); ``metric``: the columns that are complete everywhere."""
        self.metric, self.p, self.block_rows = metric, p, block_rows
        count = min(MAX_PIVOTS, math.ceil(math.sqrt(n))) if metric else 1
        some = base.orderBy(F.xxhash64("bk"), "bk").limit(max(count, 1)).collect()
        self.pivots = np.unique(np.array([[r["x"][i] for i in metric] for r in some], float).reshape(len(some), len(metric)), axis=0)
        self.base = stored(self.assigned(base, "bk"), "cells")
        rows = self.base.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r")).collect()
        self.size, self.radius = np.zeros(len(self.pivots), np.int64), np.zeros(len(self.pivots))
        for r in rows:
            self.size[r["cell"]], self.radius[r["cell"]] = r["n"], r["r"]
        self._group()

    def _group(self) -> None:
        """Cells to groups: neighbours in the pivots' order, together not above
        a block's rows and MASK_BITS cells; a larger cell is its own group."""
        self.group, self.bit = np.zeros(len(self.size), np.int64), np.zeros(len(self.size), np.int64)
        rows: list[int] = []
        cells = 0
        for c, n in enumerate(self.size.tolist()):
            if not rows or rows[-1] + n > self.block_rows or cells == MASK_BITS:
                rows.append(0)
                cells = 0
            rows[-1] += n
            self.group[c], self.bit[c] = len(rows) - 1, cells
            cells += 1
        self.blocks = np.maximum(1, -(-np.array(rows, np.int64) // self.block_rows))

    def assigned(self, df: DataFrame, key: str) -> DataFrame:
        """Rows with their cell and the distance to its pivot."""
        metric, pivots = self.metric, self.pivots

        def work(it):
            for pdf in it:
                if len(pdf):
                    x = np.array(pdf["x"].tolist(), float)[:, metric]
                    parts = [_distances(x[s:s + _SLICE], pivots) for s in range(0, len(x), _SLICE)]
                    yield pdf.assign(cell=np.concatenate([d.argmin(1) for d in parts]).astype(np.int32), dist=np.concatenate([d.min(1) for d in parts]))

        return df.mapInPandas(work, f"{key} {dict(df.dtypes)[key]}, x array<double>, cell int, dist double")

    def still_needed(self, queries: DataFrame, p: int) -> DataFrame:
        """qk, x and ``need``: the other cells that may hold one of the query's
        neighbours, given the distance ``tau`` that it has to beat."""
        metric, pivots, radius, size = self.metric, self.pivots, self.radius, self.size

        def work(it):
            for pdf in it:
                if not len(pdf):
                    continue
                x = np.array(pdf["x"].tolist(), float)
                grow = np.sqrt(p / np.maximum((~np.isnan(x)).sum(1), 1))
                own, tau = pdf["cell"].to_numpy(), pdf["tau"].to_numpy()
                found = []
                for s in range(0, len(x), _SLICE):
                    t = slice(s, s + _SLICE)
                    least = (_distances(x[t][:, metric], pivots) - radius) * grow[t, None]
                    need = (least <= _slack(tau[t])[:, None]) & (size > 0)
                    need[np.arange(len(need)), own[t]] = False
                    found += [np.flatnonzero(r).astype(np.int32) for r in need]
                yield pd.DataFrame({"qk": pdf["qk"], "x": pdf["x"], "tau": pdf["tau"], "need": found})

        return queries.mapInPandas(work, f"qk {dict(queries.dtypes)['qk']}, x array<double>, tau double, need array<int>")

    def _asked(self, queries: DataFrame) -> DataFrame:
        """A row per query and group of the cells in ``need``, those as bits of ``mask``."""
        group, bit = self.group, np.int64(1) << self.bit

        def work(it):
            for pdf in it:
                groups, masks = [], []
                for cells in pdf["need"]:
                    g = group[cells]                    # cells ascend, and so do groups
                    head = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
                    groups.append(g[head].astype(np.int32))
                    masks.append(np.bitwise_or.reduceat(bit[cells], head) if len(g) else np.zeros(0, np.int64))
                yield pd.DataFrame({"qk": pdf["qk"], "x": pdf["x"], "tau": pdf["tau"], "groups": groups, "masks": masks})

        kind = f"qk {dict(queries.dtypes)['qk']}, x array<double>, tau double, groups array<int>, masks array<long>"
        each = queries.select("qk", "x", "tau", "need").mapInPandas(work, kind)
        return each.select("qk", "x", "tau", F.inline(F.arrays_zip(F.col("groups").alias("group"), F.col("masks").alias("mask"))))

    def search(self, queries: DataFrame, k: int, exclude_self: bool, per_column: bool) -> DataFrame:
        """The k best rows of the cells in ``need`` for each query row (qk, x,
        tau, need), by tiles; none farther than ``tau``."""
        spark = self.base.sparkSession
        asked = self._asked(queries)
        counts = {r["group"]: r["n"] for r in asked.groupBy("group").agg(F.count(F.lit(1)).alias("n")).collect()}
        groups = [(g, int(self.blocks[g]), max(1, math.ceil(n / self.block_rows))) for g, n in counts.items()]
        kinds = dict(queries.dtypes)["qk"], dict(self.base.dtypes)["bk"]
        schema = f"qk {kinds[0]}, j int, bk {kinds[1]}, dist double, value double"
        shape = F.broadcast(spark.createDataFrame(groups, "group int, blocks int, slices int"))  # a row per group, MAX_PIVOTS at most
        places = F.broadcast(spark.createDataFrame([(c, int(g), int(b)) for c, (g, b) in enumerate(zip(self.group, self.bit, strict=True))], "cell int, group int, bit int"))
        q = asked.join(shape, "group").select("group", "qk", "x", "tau", "mask", F.pmod(F.xxhash64("qk"), F.col("slices")).cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        b = self.base.join(places, "cell").join(shape, "group").select("group", "bit", "bk", "x", F.pmod(F.xxhash64("bk"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))

        p = self.p

        def tile(qpdf: pd.DataFrame, bpdf: pd.DataFrame) -> pd.DataFrame:
            rows = [np.array(t["x"].tolist(), float).reshape(len(t), p) for t in (qpdf, bpdf)]
            qk, tau, mask, bk, bit = qpdf["qk"].to_numpy(), qpdf["tau"].to_numpy(), qpdf["mask"].to_numpy(), bpdf["bk"].to_numpy(), bpdf["bit"].to_numpy()
            wanted = [(((mask >> c) & 1).astype(bool), bit == c) for c in np.unique(bit)]
            if 2 * sum(int(a.sum()) * int(b.sum()) for a, b in wanted) > len(mask) * len(bit):    # most pairs: all at once
                return _tile(rows[0], qk, tau, rows[1], bk, k, exclude_self, per_column, lambda s: ((mask[s, None] >> bit[None, :]) & 1).astype(bool))
            return pd.concat([_tile(rows[0][:0], qk[:0], tau[:0], rows[1], bk, k, exclude_self, per_column)]
                             + [_tile(rows[0][a], qk[a], tau[a], rows[1][b], bk[b], k, exclude_self, per_column) for a, b in wanted if a.any()], ignore_index=True)

        on = ["group", "block", "slice"]
        return q.groupBy(*on).cogroup(b.groupBy(*on)).applyInPandas(tile, schema)


def _best(cand: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qk", "j").orderBy("dist", "bk")
    return cand.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def knn_candidates(query: DataFrame, base: DataFrame, qkey: str, bkey: str, cols: list[str], k: int,
                   exclude_self: bool = False, per_column: bool = False) -> DataFrame:
    """k nearest base rows of every query row: ``(qk, j, bk, dist, value)``.

    ``per_column``: NaN-Euclidean distance, and for each column ``j`` missing
    in the query row the k nearest base rows where ``j`` is present (with
    that value); otherwise plain Euclidean over complete rows (``j = -1``).
    Ties are broken by the base key.
    """
    return neighbour_search(query, base, qkey, bkey, cols, k, exclude_self, per_column)[0]


def neighbour_search(query: DataFrame, base: DataFrame, qkey: str, bkey: str, cols: list[str], k: int, exclude_self: bool = False,
                     per_column: bool = False) -> tuple[DataFrame, CellIndex, DataFrame]:
    """The candidates of ``knn_candidates``, the index, and the cells that each
    query needed besides its own."""
    p = len(cols)
    x = F.array(*[qcol(c).cast("double") for c in cols])
    q, b = query.select(qcol(qkey).alias("qk"), x.alias("x")), base.select(qcol(bkey).alias("bk"), x.alias("x"))
    if per_column:
        q = q.filter(F.exists("x", F.isnull))
    gaps = [F.sum(F.col("x")[i].isNull().cast("long")).alias(f"g{i}") for i in range(p)]
    nb, *base_gaps = b.agg(F.count(F.lit(1)), *gaps).first()
    query_gaps = q.agg(*gaps).first()
    metric = [i for i in range(p) if not base_gaps[i] and not query_gaps[i]]
    if len(metric) == p:
        # of rows that coincide no query takes more than k, itself left out: the first keys do
        same = Window.partitionBy("x").orderBy("bk")
        b = stored(b.withColumn("_r", F.dense_rank().over(same)).where(F.col("_r") <= k + 2).drop("_r"), "base")
        nb = b.count()
    index = CellIndex(b, nb, metric, p, conf_int(query.sparkSession, "prepforge.knn.blockRows"))
    own = stored(index.assigned(q, "qk"), "queries")
    home = own.select("qk", "x", F.lit(float("inf")).alias("tau"), F.array("cell").alias("need"))
    first = stored(_best(index.search(home, k, exclude_self, per_column), k), "near")
    # the distance to beat: the k-th so far, for every column wanted; none where one has fewer
    lists = first.groupBy("qk", "j").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("d"))
    reached = lists.where(F.col("n") >= k).groupBy("qk").agg(F.count(F.lit(1)).alias("lists"), F.max("d").alias("tau"))
    wanted = F.size(F.filter("x", F.isnull)) if per_column else F.lit(1)
    tau = F.when(F.col("lists") >= wanted, F.col("tau")).otherwise(F.lit(float("inf")))
    queries = own.join(reached, "qk", "left").select("qk", "x", "cell", tau.alias("tau"))
    need = stored(index.still_needed(queries, p), "needed")
    rest = index.search(need, k, exclude_self, per_column)
    return _best(first.unionByName(rest), k), index, need


def knn_approximate(query: DataFrame, base: DataFrame, qkey: str, bkey: str, cols: list[str], k: int, radius: float, bucket_length: float,
                    tables: int = 4, exclude_self: bool = False, seed: int = 0) -> DataFrame:
    """Approximate neighbours by random-projection LSH, for sizes at which an
    exact search is too long: up to k base rows within ``radius`` that share a
    bucket with the query in one of ``tables`` hash tables. Complete rows only."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    x = F.array(*[qcol(c).cast("double") for c in cols])
    rows = lambda df, key: df.select(qcol(key).alias("k"), array_to_vector(x).alias("x"))
    q, b = rows(query, qkey), rows(base, bkey)
    model = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", bucketLength=bucket_length, numHashTables=tables, seed=seed).fit(b)
    pairs = model.approxSimilarityJoin(q, b, radius, "dist").select(F.col("datasetA.k").alias("qk"), F.lit(-1).alias("j"), F.col("datasetB.k").alias("bk"), "dist", F.lit(0.0).alias("value"))
    return _best(pairs.where("qk <> bk") if exclude_self else pairs, k)


# ---------------------------------------------------------------- kNN imputation

class KnnImputeFitted(Fitted):
    """Imputed values depend on the fit rows, so the fitted state keeps the
    fit frame (lazily) and the column means; transform = candidates join."""

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.params
        key, cols, k = p["key"], self.cols, p["k"]
        base = p["_base"]
        if df.where(F.exists(F.array(*[qcol(c).cast("double") for c in cols]), F.isnull)).isEmpty():
            return df.withColumns({c: qcol(c).cast("double") for c in cols})    # nothing to search for
        cand = knn_candidates(df, base, key, key, cols, k, per_column=True)
        fill = cand.groupBy("qk", "j").agg(F.avg("value").alias("v"))
        wide = fill.groupBy("qk").agg(*[F.max(F.when(F.col("j") == i, F.col("v"))).alias(f"_f{i}")
                                        for i in range(len(cols))])
        j = df.join(wide, qcol(key) == F.col("qk"), "left")
        ex = {c: F.coalesce(qcol(c).cast("double"), F.col(f"_f{i}"), F.lit(p["means"][c]))
              for i, c in enumerate(cols)}
        return j.withColumns(ex).drop("qk", *[f"_f{i}" for i in range(len(cols))])


@register("imputation", "knn")
class KnnImpute(PrepOp):
    """Mean of the column over the k nearest fit rows where it is present
    (NaN-Euclidean distance over all numeric features); no donor -> column
    mean. Categorical columns take the most frequent value."""
    stage = "imputation"

    def fit(self, df: DataFrame, cols: list[str], label: str | None = None) -> Fitted:
        from prepforge.functions.stats import categorical_cols, modes
        key = self.kw.get("key")
        num = numeric_cols(df, cols)
        if key is None:
            raise ValueError("kNN imputation needs a row key (kw key=...)")
        row = agg_row(df, {f"m{i}": F.avg(qcol(c)) for i, c in enumerate(num)})
        fitted = KnnImputeFitted("impute.knn", num, {"key": key, "k": int(self.kw.get("k", KNN_IMPUTE_K)),
                                                     "means": {c: row[f"m{i}"] for i, c in enumerate(num)},
                                                     "_base": df.select(qcol(key), *[qcol(c) for c in num])})
        cats = categorical_cols(df, cols)
        if cats:
            from prepforge.operators.imputation import FillFitted
            return _Chain("impute.knn", cols, {"parts": [fitted, FillFitted("impute.mode", cats,
                                                                              {"fill": modes(df, cats)})]})
        return fitted


class _Chain(Fitted):
    def transform(self, df):
        for f in self.params["parts"]:
            df = f.transform(df)
        return df


# ---------------------------------------------------------------- LOF

def lof_scores(df: DataFrame, key: str, cols: list[str], k: int = LOF_K) -> DataFrame:
    """Local outlier factor of every row of ``df`` among ``df`` (self
    excluded): three joins over the stored n*k edge table."""
    df = stored(df.select(qcol(key), *[qcol(c) for c in cols]), "rows")
    e = stored(knn_candidates(df, df, key, key, cols, k, exclude_self=True).select("qk", "bk", "dist"), "edges")
    kd = e.groupBy("qk").agg(F.max("dist").alias("kdist"))
    reach = (e.join(kd.withColumnRenamed("qk", "bk").withColumnRenamed("kdist", "kd_b"), "bk")
             .withColumn("reach", F.greatest("kd_b", "dist")))
    lrd = reach.groupBy("qk").agg((1.0 / (F.avg("reach") + F.lit(LOF_EPS))).alias("lrd"))
    nb = e.join(lrd.withColumnRenamed("qk", "bk").withColumnRenamed("lrd", "lrd_b"), "bk")
    lof = nb.groupBy("qk").agg(F.avg("lrd_b").alias("m")).join(lrd, "qk")
    return lof.select(F.col("qk").alias(key), (F.col("m") / F.col("lrd")).alias("lof"))


class KeyedRowFilter(Fitted):
    """Train-only row removal decided per fit row (kept as a key table)."""

    def transform(self, df: DataFrame) -> DataFrame:
        p = self.params
        key, split_col = p["key"], p.get("split_col")
        flagged = p["_flagged"]
        j = df.join(flagged.withColumn("_out", F.lit(True)), key, "left")
        drop = F.coalesce(F.col("_out"), F.lit(False))
        if split_col and split_col in df.columns:
            drop = drop & (F.col(split_col) == "train")
        return j.filter(~drop).drop("_out")

    def weight_frame(self) -> DataFrame:
        return self.params["_flagged"].withColumn("_keep", F.lit(0.0))


@register("outlier_removal", "lof")
class RemoveLOF(PrepOp):
    stage = "outlier_removal"

    def fit(self, df: DataFrame, cols: list[str], label: str | None = None) -> Fitted:
        key = self.kw.get("key")
        if key is None:
            raise ValueError("LOF needs a row key (kw key=...)")
        cols = numeric_cols(df, cols)
        n = df.count()
        k = min(int(self.kw.get("k", LOF_K)), max(n - 1, 1))
        sc = lof_scores(df.select(qcol(key), *[qcol(c) for c in cols]), key, cols, k)
        flagged = stored(sc.filter(F.col("lof") > LOF_CUT).select(key), "flagged")
        return KeyedRowFilter("remove.lof", cols, {"key": key, "split_col": self.kw.get("split_col"),
                                                   "_flagged": flagged, "k": k})
