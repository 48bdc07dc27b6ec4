"""Sufficient statistics by missing pattern.

Rows that miss the same columns share a pattern. Its number of rows, sums and
cross products of the observed values say all that moment-based imputers need
of those rows, so one scan serves every iteration. A task adds up its batches
per pattern; a pattern's partial sums meet in salted parts first, so one that
a third of the rows have is no hot group. A table of up to ``LOCAL_BYTES``
comes to the driver and iterations run there; a larger one stays stored and
each pass over the patterns is a job over it, by the same function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepforge.functions.stats import agg_row, qcol
from prepforge.session import stored

#: Bytes of pattern statistics that may come to the driver.
LOCAL_BYTES = 64 << 20
#: Patterns that a task holds before it passes their sums on, and parts of a pattern.
HELD_PATTERNS = 512
SALTS = 32

#: (missing mask, rows, sums, cross products); values less the column's mean, 0 where missing.
Pattern = tuple[np.ndarray, float, np.ndarray, np.ndarray]


def matrix(batch: pa.RecordBatch, p: int) -> np.ndarray:
    """The rows of a batch of p double columns, NaN where missing."""
    if not batch.num_rows:
        return np.zeros((0, p))
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(p)])


def by_pattern(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(missing mask, row numbers) of each pattern of some rows."""
    miss = np.isnan(x)
    _, first, of = np.unique(np.packbits(miss, axis=1), axis=0, return_index=True, return_inverse=True)
    of = of.reshape(-1)
    order = np.argsort(of, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []:
        yield miss[rows[0]], rows


def _row(mask: bytes, v: np.ndarray) -> dict:
    return {"pattern": mask, "v": v}


def _partial(batches: Iterator[pa.RecordBatch], shift: np.ndarray) -> Iterator[pa.RecordBatch]:
    p = len(shift)
    held: dict[bytes, np.ndarray] = {}

    def out() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_pydict({"pattern": pa.array(list(held), pa.binary()), "v": pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))})
        held.clear()
        return rows

    upper = np.triu_indices(p)
    for batch in batches:
        x = matrix(batch, p) - shift
        for miss, rows in by_pattern(x):
            z = np.nan_to_num(x[rows])
            key = np.packbits(miss).tobytes()
            v = np.concatenate([[len(rows)], z.sum(0), (z.T @ z)[upper]])
            held[key] = held[key] + v if key in held else v
            if len(held) >= HELD_PATTERNS:
                yield out()
    yield out()


def _folded(keys: tuple, t: pa.Table) -> pa.Table:
    cells = t.column("v").combine_chunks()
    total = cells.flatten().to_numpy().reshape(t.num_rows, -1).sum(0)
    return pa.table({"pattern": pa.array([keys[0].as_py()], pa.binary()), "v": pa.array([total.tolist()], pa.list_(pa.float64()))})


def _unpacked(pattern: bytes, v: np.ndarray, p: int) -> Pattern:
    cross = np.zeros((p, p))
    cross[np.triu_indices(p)] = v[1 + p:]
    return np.unpackbits(np.frombuffer(pattern, np.uint8), count=p).astype(bool), float(v[0]), v[1:1 + p], cross + np.triu(cross, 1).T


class Patterns:
    """Pattern statistics of some numeric columns of a table."""

    def __init__(self, df: DataFrame, cols: list[str], local_bytes: int = LOCAL_BYTES) -> None:
        self.cols, self.p = cols, len(cols)
        self.rows = df.select(*[F.when(~F.isnan(qcol(c).cast("double")), qcol(c).cast("double")).alias(c) for c in cols])
        row = agg_row(self.rows, {**{f"m{i}": F.avg(qcol(c)) for i, c in enumerate(cols)}, **{f"v{i}": F.var_pop(qcol(c)) for i, c in enumerate(cols)},
                                  **{f"n{i}": F.sum(qcol(c).isNull().cast("long")) for i, c in enumerate(cols)}, **{f"a{i}": F.max(F.abs(qcol(c))) for i, c in enumerate(cols)}})
        get = lambda k: np.array([row[f"{k}{i}"] or 0.0 for i in range(self.p)], float)
        self.means, self.variances, self.missing, self.largest = get("m"), get("v"), get("n"), get("a")
        shift = self.means
        kind = "pattern binary, v array<double>"
        parts = self.rows.mapInArrow(lambda it: _partial(it, shift), kind).withColumn("salt", F.spark_partition_id() % SALTS)
        folded = parts.groupBy("pattern", "salt").applyInArrow(_folded, kind).groupBy("pattern").applyInArrow(_folded, kind)
        self.table = stored(folded, "patterns")
        size = self.table.count() * 8 * (1 + self.p + self.p * (self.p + 1) // 2)
        self.local: list[Pattern] | None = None
        if size <= local_bytes:
            t = self.table.orderBy("pattern").collect()
            self.local = [_unpacked(bytes(r["pattern"]), np.array(r["v"]), self.p) for r in t]

    def total(self, work: Callable[[Pattern], np.ndarray], size: int) -> np.ndarray:
        """The sum of ``work`` (vectors of ``size``) over all patterns."""
        if self.local is not None:
            return sum((work(x) for x in self.local), np.zeros(size))
        p = self.p

        def job(batches):
            acc = np.zeros(size)
            for b in batches:
                for key, v in zip(b.column("pattern").to_pylist(), b.column("v"), strict=True):
                    acc += work(_unpacked(key, v.values.to_numpy(), p))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(acc)], ["i", "x"])

        out = np.zeros(size)
        for r in self.table.mapInArrow(job, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            out[r["i"]] = r["x"]
        return out
