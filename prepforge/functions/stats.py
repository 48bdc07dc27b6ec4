"""Distributed column statistics.

* ``agg_row``      - every statistic of a stage in ONE aggregation job.
* ``order_stats``  - exact k-th smallest values of many columns and ranks at
  once: one histogram per range, shared by all its ranks, and one value per
  rank to the driver.
* ``quantiles``    - linear-interpolation percentiles (numpy ``linear``).
* ``value_counts`` / ``modes`` - per-column value histograms computed as one
  exploded ``groupBy`` (map-side partial aggregation absorbs hot values).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def is_numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, NUMERIC_TYPES)


def numeric_cols(df: DataFrame, cols: Iterable[str]) -> list[str]:
    return [c for c in cols if is_numeric(df, c)]


def categorical_cols(df: DataFrame, cols: Iterable[str]) -> list[str]:
    return [c for c in cols if not is_numeric(df, c)]


def qcol(c: str) -> Column:
    """Column by name; names with dots or '>' are back-quoted."""
    return F.col(f"`{c}`")


def agg_row(df: DataFrame, named: dict[str, Column]) -> dict:
    """Run all aggregates in a single job; returns {alias: value}."""
    if not named:
        return {}
    row = df.agg(*[e.alias(k) for k, e in named.items()]).collect()[0]
    return row.asDict()


# --------------------------------------------------------------------------
# exact order statistics
# --------------------------------------------------------------------------

#: Buckets of a histogram; rows of a bucket that are put in order at once.
BUCKETS = 4096
FINISH_ROWS = 4096
#: Ranges counted in one pass (bounds the histograms a task holds: 50 MB).
PASS_RANGES = 512


class _Range(NamedTuple):
    """A range of one column's values (as ordered integers) that still holds
    wanted ranks; ``before`` values of the column lie below it."""

    col: int
    low: int
    high: int
    before: int
    rows: int

    @property
    def width(self) -> int:
        """Of a bucket, in integers."""
        return (self.high - self.low) // BUCKETS + 1


def ordered_keys(x: np.ndarray) -> np.ndarray:
    """Doubles as signed integers in the same order (-0.0 as 0.0)."""
    k = (x + 0.0).view(np.int64)
    return k ^ ((k >> np.int64(63)) & np.int64((1 << 63) - 1))


def _key(x: float) -> int:
    return int(ordered_keys(np.array([x], float))[0])


def _values(batch: pa.RecordBatch, col: int) -> np.ndarray:
    x = batch.column(col).to_numpy(zero_copy_only=False).astype(float)
    return x[~np.isnan(x)]


def _inside(x: np.ndarray, k: np.ndarray, r: _Range) -> tuple[np.ndarray, np.ndarray]:
    on = (k >= r.low) & (k <= r.high)
    return x[on], k[on]


def _histograms(batches: Iterator[pa.RecordBatch], ranges: list[_Range]) -> Iterator[pa.RecordBatch]:
    """A task's counts, least and greatest values of every bucket of every range."""
    counts = np.zeros((len(ranges), BUCKETS), np.int64)
    least, most = np.full(counts.shape, np.inf), np.full(counts.shape, -np.inf)
    for batch in batches:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i, r in enumerate(ranges):
            if r.col not in seen:
                x = _values(batch, r.col)
                seen = {r.col: (x, ordered_keys(x))}
            x, k = _inside(*seen[r.col], r)
            b = ((k.view(np.uint64) - np.uint64(r.low & (1 << 64) - 1)) // np.uint64(r.width)).astype(np.int64)
            counts[i] += np.bincount(b, minlength=BUCKETS)
            np.minimum.at(least[i], b, x)
            np.maximum.at(most[i], b, x)
    i, b = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[i, b]), pa.array(least[i, b]), pa.array(most[i, b])], ["i", "b", "n", "mn", "mx"])


def _within(batches: Iterator[pa.RecordBatch], ranges: list[_Range]) -> Iterator[pa.RecordBatch]:
    """The values of some (small) ranges."""
    ranges = sorted(enumerate(ranges), key=lambda e: e[1].col)
    for batch in batches:
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i, r in ranges:
            if r.col not in seen:
                x = _values(batch, r.col)
                seen = {r.col: (x, ordered_keys(x))}
            x, _ = _inside(*seen[r.col], r)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), i), pa.int32()), pa.array(x)], ["i", "x"])


def order_stats(df: DataFrame, exprs: dict[str, Column], ranks: dict[str, Sequence[int]],
                profile: dict | None = None) -> dict[str, list[float]]:
    """Exact ``rank``-th smallest value (0-based, missing ones left out) of
    each expression; all columns and ranks together.

    Each pass counts the values of the ranges that still hold a wanted rank in
    ``BUCKETS`` buckets, in numpy per task. A range's histogram serves all its
    ranks: a window over the summed buckets (``BUCKETS`` rows a range) gives
    running counts, and the bucket of each rank comes back, one row a rank. A
    bucket of one value answers at once, however many rows have it; one of at
    most ``FINISH_ROWS`` rows is put in order by an executor; any other is the
    next range. Buckets divide the doubles' own order, so six passes end it
    for any spread. ``profile`` may carry ``{name: (rows, least, greatest)}``.
    """
    names = [c for c in ranks if len(ranks[c])]
    if not names:
        return {c: [] for c in ranks}
    profile = profile or profile_numeric(df, {c: exprs[c] for c in names})
    rows = df.select(*[exprs[c].cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    spark = df.sparkSession
    found: dict[tuple[int, int], float] = {}
    wanted: dict[_Range, list[int]] = {}
    for i, c in enumerate(names):
        n, least, most = profile[c]
        wanted[_Range(i, _key(least), _key(most), 0, n)] = sorted(set(ranks[c]))
    while wanted:
        small = [r for r in wanted if r.rows <= FINISH_ROWS]
        large = sorted((r for r in wanted if r.rows > FINISH_ROWS), key=lambda r: r.col)
        ask = lambda part: F.broadcast(spark.createDataFrame([(i, k - r.before) for i, r in enumerate(part) for k in wanted[r]], "t int, k long"))
        following = {r: wanted[r] for r in large[PASS_RANGES:]}
        large = large[:PASS_RANGES]
        if small:
            lists = rows.mapInArrow(lambda it, small=small: _within(it, small), "i int, x double").groupBy("i").agg(F.sort_array(F.collect_list("x")).alias("xs"))
            for t in lists.join(ask(small), F.col("i") == F.col("t")).select("t", "k", F.expr("element_at(xs, cast(k + 1 AS int))").alias("x")).collect():
                found[small[t["t"]].col, t["k"] + small[t["t"]].before] = t["x"]
        if large:
            parts = rows.mapInArrow(lambda it, large=large: _histograms(it, large), "i int, b int, n long, mn double, mx double")
            hist = parts.groupBy("i", "b").agg(F.sum("n").alias("n"), F.min("mn").alias("mn"), F.max("mx").alias("mx"))
            upto = F.sum("n").over(Window.partitionBy("i").orderBy("b"))
            hit = hist.withColumn("before", upto - F.col("n")).join(ask(large), (F.col("i") == F.col("t")) & (F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("n")))
            for t in hit.select("t", "k", "n", "mn", "mx", "before").collect():
                r = large[t["t"]]
                k = t["k"] + r.before
                if t["mn"] == t["mx"]:
                    found[r.col, k] = t["mn"]
                else:
                    following.setdefault(_Range(r.col, _key(t["mn"]), _key(t["mx"]), r.before + t["before"], t["n"]), []).append(k)
        wanted = following
    place = {c: i for i, c in enumerate(names)}
    return {c: [float(found[place[c], k]) for k in ranks[c]] for c in ranks}


def profile_numeric(df: DataFrame, exprs: dict[str, Column]) -> dict[str, tuple[int, float, float]]:
    """Number of values, least and greatest of each expression, in one job (NaN counts as missing)."""
    named = {}
    for i, (c, e) in enumerate(exprs.items()):
        x = F.nanvl(e.cast("double"), F.lit(None).cast("double"))
        named |= {f"n{i}": F.count(x), f"mn{i}": F.min(x), f"mx{i}": F.max(x)}
    row = agg_row(df, named)
    return {c: (row[f"n{i}"], row[f"mn{i}"], row[f"mx{i}"]) for i, c in enumerate(exprs)}


def quantiles(df: DataFrame, cols: Sequence[str] | dict[str, Column], probs: Sequence[float],
              profile: dict | None = None) -> dict[str, list[float | None]]:
    """numpy-``linear`` percentiles (= Spark ``percentile`` = DuckDB
    ``quantile_cont``), missing ignored; None for an all-missing column."""
    exprs = cols if isinstance(cols, dict) else {c: qcol(c) for c in cols}
    if profile is None:
        profile = profile_numeric(df, exprs)
    ranks: dict[str, list[int]] = {}
    plan: dict[str, list[tuple[int, int, float]]] = {}
    for c in exprs:
        n = profile[c][0]
        if n == 0:
            continue
        rs = set()
        plan[c] = []
        for p in probs:
            pos = (n - 1) * p
            lo = int(math.floor(pos))
            hi = int(math.ceil(pos))
            plan[c].append((lo, hi, pos - lo))
            rs.update((lo, hi))
        ranks[c] = sorted(rs)
    got = order_stats(df, {c: exprs[c] for c in ranks}, ranks, profile)
    out: dict[str, list[float | None]] = {}
    for c in exprs:
        if c not in plan:
            out[c] = [None] * len(probs)
            continue
        vals = dict(zip(ranks[c], got[c]))
        res = []
        for lo, hi, frac in plan[c]:
            a, b = vals[lo], vals[hi]
            res.append(a if hi == lo else a + (b - a) * frac)
        out[c] = res
    return out


def medians(df: DataFrame, exprs: dict[str, Column]) -> dict[str, float | None]:
    return {c: v[0] for c, v in quantiles(df, exprs, [0.5]).items()}


# --------------------------------------------------------------------------
# value histograms (mode, vocabularies, count encoders)
# --------------------------------------------------------------------------

def value_counts(df: DataFrame, cols: Sequence[str], key: str | None = None,
                 keep_null: bool = False) -> DataFrame:
    """Long histogram ``(cid, name, d, s, cnt[, first_key])`` of every column:
    numeric columns fill ``d``, others ``s``. One shuffle for all columns."""
    items = []
    for i, c in enumerate(cols):
        num = is_numeric(df, c)
        fields = [F.lit(i).alias("cid"),
                  (qcol(c).cast("double") if num else F.lit(None).cast("double")).alias("d"),
                  (F.lit(None).cast("string") if num else qcol(c).cast("string")).alias("s"),
                  qcol(c).isNull().alias("isnull")]
        if key is not None:
            fields.append(qcol(key).alias("k"))
        st = F.struct(*fields)
        items.append(st if keep_null else F.when(qcol(c).isNotNull(), st))
    long = df.select(F.inline(F.filter(F.array(*items), lambda e: e.isNotNull())))
    aggs = [F.count(F.lit(1)).alias("cnt")]
    if key is not None:
        aggs.append(F.min("k").alias("first_key"))
    names = F.array(*[F.lit(c) for c in cols])
    return (long.groupBy("cid", "d", "s", "isnull").agg(*aggs)
            .withColumn("name", F.element_at(names, F.col("cid") + 1)))


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent non-missing value; ties resolve to the smallest value."""
    if not cols:
        return {}
    vc = value_counts(df, cols)
    rows = (vc.groupBy("cid", "name")
            .agg(F.min_by(F.struct("d", "s"), F.struct((-F.col("cnt")).alias("nc"), "d", "s")).alias("m"))
            .collect())
    out: dict[str, object] = {c: None for c in cols}
    for r in rows:
        c = r["name"]
        out[c] = r["m"]["d"] if is_numeric(df, c) else r["m"]["s"]
    return out


def round_cols(df: DataFrame, cols: Iterable[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(qcol(c).cast("double"), places) for c in cols})
