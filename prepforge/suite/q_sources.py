"""Queries: sources, filters, splits, labels, profiling, catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

import os
import uuid

from prepforge.plans.catalog import admit, ntile_positions, pending, status_ids, status_report
from prepforge.sources import dataset as D
from prepforge.sources import sinks as S
from prepforge.operators.split import batch_sample, bounded_sample, union_train_val
from prepforge.session import ensure_checkpoint_dir
from prepforge.suite.frames import SQL_E, SQL_O, frame_E, frame_O, sql_split, table
from prepforge.suite.helpers import query, rounded, split_frame

SQL_O_SPLIT = sql_split(SQL_O, "o_orderkey")
SQL_E_SPLIT = sql_split(SQL_E, "event_id")


@query("split_train_val_test", f"SELECT o_orderkey, split FROM ({SQL_O_SPLIT})")
def q_split(spark, sf):
    return split_frame(frame_O(spark, sf), "o_orderkey").select("o_orderkey", "split")


@query("union_train_val", f"SELECT o_orderkey, split FROM ({SQL_O_SPLIT}) WHERE split IN ('train', 'val')")
def q_union(spark, sf):
    return union_train_val(split_frame(frame_O(spark, sf), "o_orderkey")).select("o_orderkey", "split")


@query("subsample", """SELECT event_id FROM (
  SELECT event_id, row_number() OVER (ORDER BY md5(concat('42', ':', CAST(event_id AS VARCHAR))), event_id) AS rn
  FROM events) WHERE rn <= 5000""")
def q_subsample(spark, sf):
    return bounded_sample(table(spark, sf, "events"), "event_id", 5000, seed=42).select("event_id")


# NA tokens are planted by key in text renderings of events (SRC2): after
# token mapping and type inference the value column is numeric again.
_TOKENS_SQL = """SELECT event_id,
  TRY_CAST(CASE WHEN v IN ({toks}) THEN NULL ELSE v END AS DOUBLE) AS value_t,
  CASE WHEN t IN ({toks}) THEN NULL ELSE t END AS type_t
FROM (SELECT event_id,
        CASE WHEN event_id % 5 = 0 THEN 'NA' WHEN event_id % 5 = 1 THEN '' WHEN event_id % 17 = 2 THEN '?'
             ELSE CAST(value AS VARCHAR) END AS v,
        CASE WHEN event_id % 6 = 0 THEN 'null' WHEN event_id % 6 = 1 THEN 'nan' ELSE event_type END AS t
      FROM events)"""
_TOKENS = list(D.DEFAULT_NA_TOKENS) + ["?"]


@query("src_na_tokens", _TOKENS_SQL.format(toks=", ".join("'" + t.replace("'", "''") + "'" for t in _TOKENS)))
def q_na_tokens(spark, sf):
    e = table(spark, sf, "events")
    raw = e.select(
        "event_id",
        F.when(F.col("event_id") % 5 == 0, "NA").when(F.col("event_id") % 5 == 1, "")
         .when(F.col("event_id") % 17 == 2, "?").otherwise(F.col("value").cast("string")).alias("value_t"),
        F.when(F.col("event_id") % 6 == 0, "null").when(F.col("event_id") % 6 == 1, "nan")
         .otherwise(F.col("event_type")).alias("type_t"))
    spec = D.DatasetSpec(label="type_t", missing_value="?")
    df = D.null_tokens(raw, spec.tokens())
    return D.infer_types(df, keep_string={"event_id"})


@query("flt_large_cat", """SELECT 'p_name' AS column_name, count(DISTINCT p_name) > 1000 AS dropped FROM part
UNION ALL SELECT 'p_brand', count(DISTINCT p_brand) > 1000 FROM part
UNION ALL SELECT 'p_type', count(DISTINCT p_type) > 1000 FROM part""")
def q_large_cat(spark, sf):
    p = table(spark, sf, "part")
    cols = ["p_name", "p_brand", "p_type"]
    big = set(D.large_categoricals(p, cols))
    return spark.createDataFrame([(c, c in big) for c in cols], "column_name string, dropped boolean")


@query("flt_all_na", f"""WITH s AS (SELECT *, CASE WHEN split <> 'train' THEN value_m END AS eval_only FROM ({SQL_E_SPLIT}))
SELECT 'value_m' AS column_name, count(value_m) FILTER (WHERE split = 'train') = 0 AS dropped FROM s
UNION ALL SELECT 'type_m', count(type_m) FILTER (WHERE split = 'train') = 0 FROM s
UNION ALL SELECT 'user_m', count(user_m) FILTER (WHERE split = 'train') = 0 FROM s
UNION ALL SELECT 'eval_only', count(eval_only) FILTER (WHERE split = 'train') = 0 FROM s""")
def q_all_na(spark, sf):
    s = split_frame(frame_E(spark, sf), "event_id")
    s = s.withColumn("eval_only", F.when(F.col("split") != "train", F.col("value_m")))
    cols = ["value_m", "type_m", "user_m", "eval_only"]
    _, dead = D.drop_all_missing(s, cols, where=F.col("split") == "train")
    return spark.createDataFrame([(c, c in dead) for c in cols], "column_name string, dropped boolean")


@query("profile_missing", f"""SELECT sum((value_m IS NULL)::BIGINT + (type_m IS NULL)::BIGINT + (user_m IS NULL)::BIGINT
    + (event_id IS NULL)::BIGINT + (event_type IS NULL)::BIGINT) AS num_missing_values,
  round(100.0 * sum((value_m IS NULL)::BIGINT + (type_m IS NULL)::BIGINT + (user_m IS NULL)::BIGINT
    + (event_id IS NULL)::BIGINT + (event_type IS NULL)::BIGINT) / (count(*) * 5), 2) AS missing_percentage,
  count(*) AS num_samples, 4 AS num_features, count(DISTINCT event_type) AS num_classes,
  'classification' AS task_type
FROM ({SQL_E})""")
def q_profile_missing(spark, sf):
    card = D.profile(frame_E(spark, sf), "event_type")
    return card.select("num_missing_values", "missing_percentage", "num_samples", "num_features", "num_classes",
                       "task_type")


@query("profile_outlier_rows", f"""WITH s AS (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS s1,
    avg(cust) AS m2, stddev_pop(cust) AS s2, avg(o_orderkey) AS m3, stddev_pop(o_orderkey) AS s3 FROM ({SQL_O}))
SELECT count(*) FILTER (WHERE abs((o_totalprice - m1) / s1) > 3 OR abs((cust - m2) / s2) > 3
                        OR abs((o_orderkey - m3) / s3) > 3) AS num_outlier_samples,
  round(100.0 * count(*) FILTER (WHERE abs((o_totalprice - m1) / s1) > 3 OR abs((cust - m2) / s2) > 3
                        OR abs((o_orderkey - m3) / s3) > 3) / count(*), 2) AS outlier_percentage
FROM ({SQL_O}), s""")
def q_profile_outliers(spark, sf):
    card = D.profile(frame_O(spark, sf), "o_orderstatus")
    return card.select("num_outlier_samples", "outlier_percentage")


@query("detect_task", """SELECT 'events' AS frame, 'event_type' AS label, 'classification' AS task_type
UNION ALL SELECT 'orders', 'o_totalprice',
  CASE WHEN count(DISTINCT o_totalprice) > 50 THEN 'regression' ELSE 'classification' END FROM orders
UNION ALL SELECT 'part', 'p_size',
  CASE WHEN count(DISTINCT p_size) > 50 THEN 'regression' ELSE 'classification' END FROM part""")
def q_detect_task(spark, sf):
    rows = [("events", "event_type", D.detect_task_type(table(spark, sf, "events"), "event_type")),
            ("orders", "o_totalprice", D.detect_task_type(table(spark, sf, "orders"), "o_totalprice")),
            ("part", "p_size", D.detect_task_type(table(spark, sf, "part"), "p_size"))]
    return spark.createDataFrame(rows, "frame string, label string, task_type string")


@query("rare_class", """SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 5)""")
def q_rare_class(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return D.rare_class_filter(o, "o_custkey")


@query("label_encode", """WITH k AS (SELECT o_orderstatus, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::INTEGER AS label
  FROM (SELECT DISTINCT o_orderstatus FROM orders))
SELECT o.o_orderkey, k.label FROM orders o JOIN k ON o.o_orderstatus = k.o_orderstatus""")
def q_label_encode(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return D.encode_label(o, "o_orderstatus", out="label").select("o_orderkey", "label")


@query("ntile_tasks", "SELECT p_partkey, (ntile(7) OVER (ORDER BY p_partkey) - 1)::INTEGER AS chunk FROM part")
def q_ntile(spark, sf):
    return ntile_positions(table(spark, sf, "part").select("p_partkey"), "p_partkey", 7)


@query("pending_antijoin", """SELECT c_custkey FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' AND o.o_totalprice > 300000)""")
def q_pending(spark, sf):
    cat = table(spark, sf, "customer").select("c_custkey")
    done = table(spark, sf, "orders").where("o_orderstatus = 'F' and o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return pending(cat, done, "c_custkey")


@query("status_report", """SELECT o_orderstatus AS status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share,
  round(sum(o_totalprice), 6) AS total_time, round(avg(o_totalprice), 6) AS mean_time
FROM orders GROUP BY o_orderstatus""")
def q_status(spark, sf):
    o = table(spark, sf, "orders")
    return rounded(status_report(o, "o_orderstatus", "o_totalprice"))


@query("dataset_card", f"""SELECT 'o_orderstatus' AS label, 'classification' AS task_type, count(*) AS num_samples,
  4 AS num_features, count(DISTINCT o_orderstatus) AS num_classes,
  sum((prio_m IS NULL)::BIGINT) AS num_missing_values,
  round(100.0 * sum((prio_m IS NULL)::BIGINT) / (count(*) * 5), 2) AS missing_percentage
FROM ({SQL_O})""")
def q_card(spark, sf):
    card = D.profile(frame_O(spark, sf), "o_orderstatus")
    return card.select("label", "task_type", "num_samples", "num_features", "num_classes", "num_missing_values",
                       "missing_percentage")


@query("ingest_clean", """WITH o AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 10 = 0 THEN NULL
    WHEN o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3) THEN 'RARE' ELSE o_orderpriority END AS prio FROM orders)
SELECT 'o_orderkey,o_totalprice,prio' AS columns, o_orderkey, o_totalprice, prio FROM o
WHERE prio IS NOT NULL AND prio IN (SELECT prio FROM o GROUP BY prio HAVING count(*) >= 5)""")
def q_ingest(spark, sf):
    o = table(spark, sf, "orders")
    first = o.orderBy("o_orderkey").limit(3).select(F.col("o_orderkey").alias("rare_key"))
    o = o.join(F.broadcast(first), F.col("o_orderkey") == F.col("rare_key"), "left")
    prio = F.when(F.col("o_orderkey") % 10 == 0, F.lit(None)).when(F.col("rare_key").isNotNull(), "RARE").otherwise(F.col("o_orderpriority"))
    o = o.select("o_orderkey", "o_totalprice", F.lit(None).cast("double").alias("nothing"), prio.alias("prio"))
    df, _task = D.ingest_clean(o, "prio", "o_orderkey")
    return df.select(F.lit(",".join(sorted(df.columns))).alias("columns"), "o_orderkey", "o_totalprice", "prio")


@query("src_csv_round_trip", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM customer""")
def q_csv(spark, sf):
    """The table written as CSV with missing-value tokens and a metadata file
    beside it, both read back: tokens to NULL, types inferred, a column dropped."""
    import os
    import uuid

    from prepforge.session import ensure_checkpoint_dir
    at = os.path.join(ensure_checkpoint_dir(spark), f"csv-{uuid.uuid4().hex}")
    c = table(spark, sf, "customer")
    tok = lambda k, t, x: F.when(F.col("c_custkey") % k == 0, F.lit(t)).otherwise(F.col(x).cast("string")).alias(x)
    c.select("c_custkey", tok(5, "?", "c_acctbal"), tok(7, "NA", "c_mktsegment"), F.lit("x").alias("unused")).write.option("header", True).csv(f"{at}/data")
    spark.createDataFrame([("c_mktsegment", ["unused"], ["c_mktsegment"], "?")], "label string, drop_variables array<string>, categorical_variables array<string>, missing_value string").coalesce(1).write.json(f"{at}/info")
    df = D.load_csv(spark, f"{at}/data", D.load_spec(spark, f"{at}/info"))
    return df.select(F.col("c_custkey").cast("long").alias("c_custkey"), *[x for x in df.columns if x != "c_custkey"])


# ---------------------------------------------------------------- composed steps, sinks, catalogue

_BUILD = f"""SELECT event_id, type_m AS kind, value_m, user_m, 'e' || event_id AS name, CASE WHEN event_type = 'click' THEN 'c' END AS click, split,
  CASE WHEN split <> 'train' THEN value_m END AS late FROM ({SQL_E_SPLIT})"""


@query("build_data", f"""WITH s AS ({_BUILD}),
l AS (SELECT kind, row_number() OVER (ORDER BY kind) - 1 AS code FROM (SELECT DISTINCT kind FROM s WHERE kind IS NOT NULL)),
v AS (SELECT event_id, split, kind, column_name, value FROM (SELECT event_id, split, kind, value_m::VARCHAR AS value_m, user_m::VARCHAR AS user_m, name, click, late::VARCHAR AS late FROM s)
      UNPIVOT INCLUDE NULLS (value FOR column_name IN (value_m, user_m, name, click, late))),
k AS (SELECT column_name FROM v GROUP BY column_name
      HAVING count(value) FILTER (WHERE split = 'train') > 0 AND (column_name NOT IN ('name', 'click') OR count(DISTINCT value) <= 1000))
SELECT event_id, split, code::INTEGER AS label, column_name, CASE WHEN column_name = 'click' THEN value ELSE round(value::DOUBLE, 6)::VARCHAR END AS value
FROM v JOIN k USING (column_name) LEFT JOIN l USING (kind)""")
def q_build_data(spark, sf):
    """SPL2: a numeric column that only val and test rows have, one with too
    many categories, gaps, and labels to code."""
    e = frame_E(spark, sf).join(table(spark, sf, "events").select("event_id", F.col("event_type").alias("t")), "event_id")
    tagged = split_frame(e, "event_id").select("event_id", F.when(F.col("split") != "train", F.col("value_m")).alias("late"))
    df = e.join(tagged, "event_id").select("event_id", F.col("type_m").alias("kind"), "value_m", "user_m", F.concat(F.lit("e"), F.col("event_id")).alias("name"),
                                           F.when(F.col("t") == "click", "c").alias("click"), "late")
    built, out = D.build_data(df, "kind", "event_id")
    cells = [F.struct(F.lit(c).alias("column_name"), (F.col(c) if c == "click" else F.round(F.col(c), 6).cast("string")).alias("value")) for c in built.features]
    return out.select("event_id", "split", "label", F.inline(F.array(*cells)))


@query("batch_sample", """SELECT event_id FROM (
  SELECT event_id, row_number() OVER (ORDER BY md5(concat('batch3', ':', CAST(event_id AS VARCHAR))), event_id) AS rn FROM events) WHERE rn <= 512""")
def q_batch(spark, sf):
    """SPL3: the batch of one epoch."""
    return batch_sample(table(spark, sf, "events"), "event_id", 512, 3).select("event_id")


@query("missing_flags", f"""SELECT 'value_m' AS column_name, bool_or(value_m IS NULL) AS has_missing FROM ({SQL_E})
UNION ALL SELECT 'type_m', bool_or(type_m IS NULL) FROM ({SQL_E}) UNION ALL SELECT 'event_type', bool_or(event_type IS NULL) FROM ({SQL_E})""")
def q_missing_flags(spark, sf):
    flags = D.missing_flags(frame_E(spark, sf), ["value_m", "type_m", "event_type"])
    return spark.createDataFrame(list(flags.items()), "column_name string, has_missing boolean")


def _folder(spark, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


@query("sink_dataset", f"SELECT event_id::DOUBLE AS event_id, round(value_m, 6) AS value_m, type_m, round(user_m, 6) AS user_m, event_type FROM ({SQL_E})")
def q_sink_dataset(spark, sf):
    """SNK1 and SRC6: the table with its card, saved and loaded again."""
    folder = _folder(spark, "dataset")
    e = frame_E(spark, sf)
    S.save_dataset(e, D.profile(e, "event_type"), folder, "csv")
    df, spec, features = D.load_data(spark, folder)
    return rounded(df.select(*features, spec.label))


@query("sink_trials", """SELECT o_orderstatus AS trial, count(*) AS best_epoch, round(avg(o_totalprice), 6) AS best_val_loss FROM orders GROUP BY o_orderstatus""")
def q_sink_trials(spark, sf):
    """SNK2 and SNK3: a result per trial, and the table of all trials."""
    folder = _folder(spark, "trials")
    trials = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("trial")).agg(F.count(F.lit(1)).alias("best_epoch"), F.avg("o_totalprice").alias("best_val_loss"))
    S.save_trials(trials, folder)
    return rounded(spark.read.parquet(folder))


@query("catalog_admission", """SELECT p_brand AS dataset, count(DISTINCT p_size) AS num_features, count(*) % 3 <> 0 AS has_files FROM part GROUP BY p_brand
HAVING count(*) % 3 <> 0 AND count(DISTINCT p_size) <= 45""")
def q_admit(spark, sf):
    """CAT1 and CAT2 over a catalogue with an entry a brand."""
    c = table(spark, sf, "part").groupBy(F.col("p_brand").alias("dataset")).agg(F.count_distinct("p_size").alias("num_features"), (F.count(F.lit(1)) % 3 != 0).alias("has_files"))
    return admit(c, max_features=45)


@query("status_ids", """SELECT o_orderstatus AS status, chunk, count(*) AS n, md5(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)) AS ids FROM (
  SELECT o_orderstatus, o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 1000 AS chunk FROM orders) GROUP BY ALL""")
def q_status_ids(spark, sf):
    """CAT4: lists of ids by outcome (their digests)."""
    t = status_ids(table(spark, sf, "orders"), "o_orderstatus", "o_orderkey")
    return t.select("status", "chunk", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")).alias("ids"))
