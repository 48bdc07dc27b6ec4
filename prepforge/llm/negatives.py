"""Hard-negative mining with Four-Russians scoring (operator 11).

Vectors are made whole numbers (``floor(SCALE * x)``). Candidates are packed
once: per block of rows, the two's-complement bit planes of the numbers, eight
dimensions to a byte. Anchors come in panels. For every group of eight
dimensions a panel has a table of its anchors' 256 subset sums; a plane's byte
is the index into it, so an inner product is one looked-up row per plane and
group, the planes shifted and added from the highest down. The scores are full
and exact: no candidate is skipped, sampled or estimated.

Anchors are a stated query set, taken in rounds of at most ``ROUND_BYTES``
that are sent to the tasks holding the packed blocks; candidates never move.
A round takes two passes: the best rows of the anchor's own label (positives),
then, for each positive, the best rows of other labels whose score lies within
the given shares of the positive's. A task keeps the best few of each anchor
while it reads its blocks, whatever their number, and Spark merges the tasks'
answers (by anchor, salted first).

Defined results: rows with a NULL label, a NULL vector or a NULL or non-finite
component take no part. Vectors of different lengths are compared as if padded
with zeros; an empty vector scores 0. Rows that share a ``vec_id`` are separate
candidates but never partners of an anchor with that id; each repeated anchor
row returns its own rows. A NULL id is no anchor, comes last among equal scores
and counts as the largest long. Scores beyond a long are held at its limits.
Anchors without positives, and positives without a fitting negative, return
nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prepforge.llm.util import col, store

SCALE = 256
ANCHOR_EVERY = 50
POSITIVES = 5
NEGATIVES = 3
#: A negative's score lies within these hundredths of the positive's.
LOW, HIGH = 50, 95
#: Rows of a packed block; bytes of anchor numbers (8 each) sent to a task at once.
BLOCK_ROWS = 2048
ROUND_BYTES = 8 << 20
#: Anchors whose tables are held at once, and candidate rows scored at once.
PANEL, SLICE = 256, 512
#: Partial answers of an anchor are merged in so many parts first.
SALTS = 16

_MAX, _MIN = (1 << 63) - 1, -(1 << 63)


# ------------------------------------------------------------------- packing

def whole_numbers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)``: int64, or Python integers where one needs more."""
    v = np.floor(np.asarray(values, np.float64) * scale)
    if not len(v) or np.abs(v).max() < 2.0 ** 62:
        return v.astype(np.int64)
    exact = [int(np.floor(x)) if np.isfinite(np.float64(x)) else None for x in v.tolist()]
    big = [int(a) * scale if b is None else b for a, b in zip(np.asarray(values, np.float64).tolist(), exact, strict=True)]
    return np.array(big, object)


def bit_planes(q: np.ndarray) -> np.ndarray:
    """(rows, dims) whole numbers -> (planes, groups, rows) bytes, the highest
    (negative) plane first."""
    n, dims = q.shape
    top = int(max(abs(int(q.max())), abs(int(q.min())))) if q.size else 0
    planes, groups = top.bit_length() + 1, -(-dims // 8)
    out = np.zeros((planes, groups, n), np.uint8)
    for k, p in enumerate(range(planes - 1, -1, -1)):
        bits = ((q >> p) & 1).astype(np.uint8)
        out[k] = np.packbits(bits, axis=1, bitorder="little").T
    return out


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(anchors, dims) -> (groups, 256, anchors): each anchor's sums over all
    subsets of eight dimensions."""
    a, dims = anchors.shape
    groups = -(-dims // 8)
    out = np.zeros((groups, 256, a), anchors.dtype)
    for g in range(groups):
        for i in range(8):
            d = 8 * g + i
            step = anchors[:, d] if d < dims else np.zeros(a, anchors.dtype)
            out[g, 1 << i:2 << i] = out[g, :1 << i] + step
    return out


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors) inner products by looking up and shift-adding."""
    groups = min(len(tables), planes.shape[1])
    total = np.zeros((planes.shape[2], tables.shape[2]), tables.dtype)
    for k in range(len(planes)):
        part = np.zeros_like(total)
        for g in range(groups):
            part += np.take(tables[g], planes[k, g], axis=0)
        total = total * 2 + (part if k else -part)
    return total


class Anchors(NamedTuple):
    """A round's anchors: running number, id, label, whole numbers (padded)."""

    no: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    q: np.ndarray

    def part(self, rows) -> Anchors:
        return Anchors(self.no[rows], self.ids[rows], self.labels[rows], self.q[rows])


def _matrix(vectors: pa.Array, scale: int) -> np.ndarray:
    """(rows, dims) whole numbers of a list column, padded with zeros."""
    n = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
    flat = whole_numbers(vectors.flatten().to_numpy(zero_copy_only=False), scale)
    out = np.zeros((len(n), int(n.max()) if len(n) else 0), flat.dtype)
    if len(n):
        row = np.repeat(np.arange(len(n)), n)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _pack(batches: Iterator[pa.RecordBatch], rows: int, scale: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            t = b.slice(lo, rows)
            ids = t.column("id").fill_null(_MAX).to_numpy()
            order = np.argsort(ids, kind="stable")
            planes = bit_planes(_matrix(t.column("v"), scale)[order])
            own = [pa.array(x[order]) for x in (ids, t.column("label").to_numpy())]
            ends = pa.array([0, len(order)], pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.ListArray.from_arrays(ends, x) for x in own), pa.array([planes.shape[0]], pa.int32()), pa.array([planes.shape[1]], pa.int32()), pa.array([planes.tobytes()], pa.binary())],
                                             ["ids", "labels", "planes", "groups", "bytes"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        for i in range(b.num_rows):
            ids, labels = (b.column(c)[i].values.to_numpy() for c in ("ids", "labels"))
            shape = (b.column("planes")[i].as_py(), b.column("groups")[i].as_py(), len(ids))
            yield ids, labels, np.frombuffer(b.column("bytes")[i].as_py(), np.uint8).reshape(shape)


# ------------------------------------------------------------------ selection

def _fitting(q: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """The anchors in the narrowest type that no score of the block can leave."""
    most = (max((abs(int(x)) for x in (q.max(), q.min())), default=0) if q.size else 0) * (1 << len(planes)) * max(8, q.shape[1] if q.ndim == 2 else 0) * 2
    return q.astype(np.int32 if most < 1 << 31 else np.int64 if most < 1 << 62 else object)


def _limited(s: np.ndarray) -> np.ndarray:
    if s.dtype == object:
        return np.array([min(max(int(x), _MIN), _MAX) for x in s.ravel()], np.int64).reshape(s.shape)
    return s


class Best:
    """The best ``k`` (score, id) of each of ``n`` lists, filled block by block."""

    def __init__(self, n: int, k: int) -> None:
        self.score, self.id, self.full = np.full((n, k), _MIN, np.int64), np.full((n, k), _MAX, np.int64), np.zeros((n, k), bool)

    def add(self, lists: slice | np.ndarray, score: np.ndarray, ids: np.ndarray, full: np.ndarray) -> None:
        """More (score, id) of some lists, ``full`` where there is one."""
        k = self.score.shape[1]
        s, i, f = (np.concatenate([a[lists], b], axis=1) for a, b in ((self.score, score), (self.id, ids), (self.full, full)))
        order = np.lexsort((i, ~s, ~f), axis=1)[:, :k]  # ~s falls as s rises, with no overflow
        self.score[lists], self.id[lists], self.full[lists] = (np.take_along_axis(x, order, axis=1) for x in (s, i, f))


def _top(s: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best columns of each row where ``ok`` (first column wins
    ties), and which of them exist."""
    least = np.iinfo(s.dtype).min
    masked = np.where(ok, s, least)
    rows = np.arange(len(s))
    at, full = np.zeros((len(s), k), np.int64), np.zeros((len(s), k), bool)
    left = ok.sum(axis=1)
    for j in range(min(k, s.shape[1])):
        at[:, j] = masked.argmax(axis=1)
        full[:, j] = left > j
        masked[rows, at[:, j]] = least
    return at, full


def _at_least_full(s: np.ndarray, ok: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, full = _top(s, ok, k)
    return np.take_along_axis(s, at, axis=1).astype(np.int64), ids[at], full


def _same_label(batches: Iterator[pa.RecordBatch], anchors: Anchors, k: int) -> Iterator[pa.RecordBatch]:
    """The task's best ``k`` rows of each anchor's label."""
    best = Best(len(anchors.no), k)
    of = {x: np.flatnonzero(anchors.labels == x) for x in np.unique(anchors.labels).tolist()}
    for ids, labels, planes in _blocks(batches):
        for label in set(np.unique(labels).tolist()) & of.keys():
            rows = np.flatnonzero(labels == label)
            for lo in range(0, len(of[label]), PANEL):
                some = of[label][lo:lo + PANEL]
                tables = subset_sums(_fitting(anchors.q[some], planes))
                for at in range(0, len(rows), SLICE):
                    r = rows[at:at + SLICE]
                    s = _limited(scores(tables, planes[:, :, r]).T)
                    best.add(some, *_at_least_full(s, ids[r] != anchors.ids[some][:, None], ids[r], k))
    a, j = np.nonzero(best.full)
    yield pa.RecordBatch.from_arrays([pa.array(anchors.no[a]), pa.array(best.id[a, j]), pa.array(best.score[a, j])], ["no", "id", "score"])


def _other_label(batches: Iterator[pa.RecordBatch], anchors: Anchors, low: np.ndarray, high: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The task's best ``k`` rows of other labels for each positive of each
    anchor; ``low`` and ``high`` (anchors, positives) limit the scores."""
    n, m = low.shape
    best = [Best(n, k) for _ in range(m)]
    for ids, labels, planes in _blocks(batches):
        for lo in range(0, n, PANEL):
            some = slice(lo, min(lo + PANEL, n))
            tables = subset_sums(_fitting(anchors.q[some], planes))
            for at in range(0, len(ids), SLICE):
                r = slice(at, at + SLICE)
                s = np.ascontiguousarray(_limited(scores(tables, planes[:, :, r]).T))
                other = (labels[r] != anchors.labels[some][:, None]) & (ids[r] != anchors.ids[some][:, None])
                for p in range(m):
                    ok = other & (s <= high[some, p, None]) & (s >= low[some, p, None])
                    on = np.flatnonzero(ok.any(axis=1))
                    if len(on):
                        best[p].add(lo + on, *_at_least_full(s[on], ok[on], ids[r], k))
    for p in range(m):
        a, j = np.nonzero(best[p].full)
        yield pa.RecordBatch.from_arrays([pa.array(anchors.no[a]), pa.array(np.full(len(a), p + 1), pa.int32()), pa.array(best[p].id[a, j]), pa.array(best[p].score[a, j])], ["no", "p", "id", "score"])


def _merged(answers: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best ``k`` of all tasks' answers to each list, ranked from 1."""
    order = [F.desc("score"), F.asc("id")]
    salted = answers.withColumn("salt", F.spark_partition_id() % SALTS)
    part = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(*order))).where(F.col("rank") <= k)
    return part.drop("salt").withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def _limits(score: np.ndarray, full: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest whole score of a negative; nothing fits where there is no positive."""
    lo, hi = np.full(score.shape, _MAX, np.int64), np.full(score.shape, _MIN, np.int64)
    for i, j in zip(*np.nonzero(full), strict=True):
        s = int(score[i, j])
        lo[i, j], hi[i, j] = max(-(-low * s // 100), _MIN), min(high * s // 100, _MAX)
    return lo, hi


def mine_hard_negatives(vectors: DataFrame, anchor: str, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, positives: int = POSITIVES,
                        negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_rows: int = BLOCK_ROWS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """Per anchor (rows where the SQL condition ``anchor`` on ``id`` and
    ``label`` holds), positive and negative: ``anchor_id``, ``positive_id``,
    ``positive_rank``, ``rank``, ``negative_id``, ``positive_score``,
    ``negative_score``."""
    spark = vectors.sparkSession
    v = F.transform(col(vector), lambda x: x.cast("double"))
    whole = vectors.select(col(vec_id).cast("long").alias("id"), col(label).cast("long").alias("label"), v.alias("v")).where(
        "label IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))")
    packed = store(whole.mapInArrow(lambda b: _pack(b, block_rows, scale), "ids array<long>, labels array<long>, planes int, groups int, bytes binary"), "vectors")
    asking = store(whole.where("id IS NOT NULL").where(anchor).withColumn("no", F.monotonically_increasing_id()), "anchors")
    count, dims = asking.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    out = spark.createDataFrame([], "anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long")
    if not count:
        return out
    rounds = -(-count * max(dims, 1) * 8 // round_bytes)
    # numbers dealt by hash: rounds are of one size whatever ids and labels are
    asking = store(asking.withColumn("round", F.pmod(F.xxhash64("no"), F.lit(rounds)).cast("int")).repartition("round").sortWithinPartitions("round"), "rounds") if rounds > 1 else asking.withColumn("round", F.lit(0))
    parts = []
    for i in range(rounds):
        t = asking.where(F.col("round") == i).orderBy("no").toArrow().combine_chunks()
        if not t.num_rows:
            continue
        q = _matrix(t.column("v").combine_chunks() if isinstance(t.column("v"), pa.ChunkedArray) else t.column("v"), scale)
        anchors = Anchors(*(t.column(c).to_numpy() for c in ("no", "id", "label")), q)
        parts.append(_round(packed, anchors, positives, negatives, low, high))
    for p in parts:
        out = out.unionByName(p)
    return out


def _round(packed: DataFrame, anchors: Anchors, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    spark = packed.sparkSession
    sent = spark.sparkContext.broadcast(anchors)
    near = _merged(packed.mapInArrow(lambda b: _same_label(b, sent.value, positives), "no long, id long, score long"), ["no"], positives).toArrow()
    row, rank = np.searchsorted(anchors.no, near.column("no").to_numpy()), near.column("rank").to_numpy() - 1
    ids, score, full = (np.zeros((len(anchors.no), positives), t) for t in (np.int64, np.int64, bool))
    ids[row, rank], score[row, rank], full[row, rank] = near.column("id").to_numpy(), near.column("score").to_numpy(), True
    limits = spark.sparkContext.broadcast(_limits(score, full, low, high))
    far = _merged(packed.mapInArrow(lambda b: _other_label(b, sent.value, *limits.value, negatives), "no long, p int, id long, score long"), ["no", "p"], negatives)
    a, p = np.nonzero(full)
    known = pa.table({"no": anchors.no[a], "p": pa.array(p + 1, pa.int32()), "anchor_id": anchors.ids[a], "positive_id": ids[a, p], "positive_score": score[a, p]})
    each = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(F.broadcast(spark.createDataFrame(known)), ["no", "p"])
    names = ("positive_id", "negative_id")
    each = each.withColumns({c: F.when(F.col(c) != _MAX, F.col(c)) for c in names})
    return store(each.select("anchor_id", "positive_id", F.col("p").alias("positive_rank"), "rank", "negative_id", "positive_score", "negative_score"), "negatives")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every seventh id are shifted first (a stated noise)."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    t = t.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return mine_hard_negatives(t, f"id % {ANCHOR_EVERY} = 0")


#: Every score by DuckDB's own arithmetic.
SQL = f"""
WITH w AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding, row_number() OVER () AS r FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM w),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM c a JOIN c b ON a.vec_id % {ANCHOR_EVERY} = 0 AND b.vec_id IS DISTINCT FROM a.vec_id),
p AS (SELECT ar, br, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id NULLS LAST, br) AS positive_rank FROM s WHERE same),
n AS (SELECT p.ar, p.anchor_id, p.positive_id, p.positive_rank, p.positive_score, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.id NULLS LAST, s.br) AS rank
      FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score WHERE p.positive_rank <= {POSITIVES})
SELECT anchor_id, positive_id, positive_rank::INT AS positive_rank, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
