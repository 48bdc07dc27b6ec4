"""Experiment catalogue operations (CAT1-6) as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepforge.functions.stats import qcol
from prepforge.session import cut_lineage

# Fixed value: datasets with more features are not admitted.
MAX_FEATURES = 200


def admit(catalog: DataFrame, has_files: str = "has_files", n_features: str = "num_features",
          max_features: int = MAX_FEATURES) -> DataFrame:
    """CAT1 + CAT2: dataset present and not too wide."""
    return catalog.filter(F.col(has_files) & (F.col(n_features) <= max_features))


def pending(catalog: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """CAT3: requested minus completed (left-anti join; Spark picks the
    strategy from the sides' sizes)."""
    return catalog.join(completed.select(key).distinct(), on=key, how="left_anti")


def status_report(results: DataFrame, status: str, time_col: str) -> DataFrame:
    """CAT4: count, share, total and mean time per outcome. The share uses a
    window over the (tiny) grouped result, never over data rows."""
    g = results.groupBy(qcol(status).alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(qcol(time_col)).alias("total_time"), F.avg(qcol(time_col)).alias("mean_time"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def status_ids(results: DataFrame, status: str, id_col: str, chunk_rows: int = 1000) -> DataFrame:
    """CAT4: the ids of every outcome, sorted, in lists of at most
    ``chunk_rows`` (an outcome may hold any share of all rows): status, chunk,
    ids."""
    placed, _ = global_positions(results.select(qcol(status).alias("status"), qcol(id_col).alias("id")), ["status", "id"])
    starts = placed.groupBy(F.col("status").alias("of")).agg(F.min("_pos").alias("first"))
    at = placed.join(starts, F.col("status").eqNullSafe(F.col("of"))).select("status", "id", F.floor((F.col("_pos") - F.col("first")) / chunk_rows).cast("long").alias("chunk"))
    return at.groupBy("status", "chunk").agg(F.sort_array(F.collect_list("id")).alias("ids"))


# Rows a slice of ``global_positions`` holds on average.
SLICE_ROWS = 100_000


def global_positions(df: DataFrame, order_cols: list[str | Column], out: str = "_pos",
                     slice_rows: int = SLICE_ROWS, weight: str | None = None) -> tuple[DataFrame, int]:
    """0-based position of every row in ``order_cols`` order without a
    single-partition window. The range-partitioned rows are written once, with
    their slice number, to the shared checkpoint folder: range bounds come
    from a sample that differs from job to job, so counts and positions must
    come from the same slices. Per-slice row numbers plus per-slice offsets (a
    table with one row per slice) give the position. With ``weight`` (a whole
    number column) it is the weight of all earlier rows. Returns (frame, rows),
    or the whole weight."""
    cols = [qcol(c) if isinstance(c, str) else c for c in order_cols]
    parts = max(1, -(-df.count() // slice_rows))
    r = cut_lineage(df.repartitionByRange(parts, *cols).withColumn("_pid", F.spark_partition_id()))
    before = Window.partitionBy("_pid").orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    each = F.lit(1) if weight is None else qcol(weight)
    local = r.withColumn("_loc", F.coalesce(F.sum(each).over(before), F.lit(0)))
    counts = sorted((row["_pid"], row["c"]) for row in r.groupBy("_pid").agg(F.sum(each).alias("c")).collect())
    offs, acc = [], 0
    for pid, c in counts:
        offs.append((pid, acc))
        acc += c
    off_df = df.sparkSession.createDataFrame(offs, "_pid int, _off long")
    pos = local.join(F.broadcast(off_df), "_pid").withColumn(out, F.col("_off") + F.col("_loc"))
    return pos.drop("_pid", "_loc", "_off"), acc


def ntile_positions(df: DataFrame, order_col: str, k: int, out: str = "chunk") -> DataFrame:
    """CAT5: near-equal contiguous chunks in ``order_col`` order (the first
    ``n % k`` chunks one row larger) - the ``ntile`` definition - without a
    single-partition window: range partitioning gives each task a contiguous
    slice, per-slice row numbers plus per-slice offsets (a tiny table) give
    the global position."""
    pos, n = global_positions(df, [order_col])
    q, rem = divmod(n, k)
    big = rem * (q + 1)
    chunk = F.when(F.col("_pos") < big, F.floor(F.col("_pos") / (q + 1))) \
        .otherwise(F.lit(rem) + F.floor((F.col("_pos") - big) / max(q, 1)))
    return pos.withColumn(out, chunk.cast("int")).drop("_pos")
