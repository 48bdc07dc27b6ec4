"""Derived input frames of the query suite, each defined twice with the same
expressions: a Spark DataFrame and a DuckDB SQL fragment. Missing values are
injected by key so both engines agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_DIMS = 64
BM_DIMS = N_DIMS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_E(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("value_m"),
        F.when(F.col("event_id") % 11 == 0, F.lit(None).cast("string")).otherwise(F.col("event_type")).alias("type_m"),
        F.when(F.col("event_id") % 13 == 0, F.lit(None).cast("double")).otherwise(F.col("user_id").cast("double")).alias("user_m"),
        "event_type",
    )


SQL_E = """SELECT event_id,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value_m,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS type_m,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(user_id AS DOUBLE) END AS user_m,
  event_type
FROM events"""


def frame_P(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").alias("price"),
        F.when(F.col("p_partkey") % 9 == 0, F.lit(None).cast("double")).otherwise(F.col("p_retailprice")).alias("price_m"),
        F.lit(5.0).alias("const"),
        "p_brand", "p_type",
    )


SQL_P = """SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price,
  CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_retailprice END AS price_m,
  5.0::DOUBLE AS const, p_brand, p_type
FROM part"""


def frame_O(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", "o_totalprice",
        F.col("o_custkey").cast("double").alias("cust"),
        F.when(F.col("o_orderkey") % 10 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("prio_m"),
        "o_orderstatus",
    )


SQL_O = """SELECT o_orderkey, o_totalprice, CAST(o_custkey AS DOUBLE) AS cust,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS prio_m, o_orderstatus
FROM orders"""


def frame_B(spark, sf_dir, dims: int = N_DIMS) -> DataFrame:
    b = table(spark, sf_dir, "embeddings")
    return b.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"d{i}") for i in range(dims)], "label")


def sql_B(dims: int = N_DIMS) -> str:
    cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS d{i}" for i in range(dims))
    return f"SELECT vec_id, {cols}, label FROM embeddings"


SQL_B = sql_B()


def frame_BM(spark, sf_dir) -> DataFrame:
    b = frame_B(spark, sf_dir, BM_DIMS)
    return b.withColumns({
        "d0": F.when(F.col("vec_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("d0")),
        "d1": F.when(F.col("vec_id") % 11 == 0, F.lit(None).cast("double")).otherwise(F.col("d1")),
    })


SQL_BM = f"""SELECT vec_id,
  CASE WHEN vec_id % 7 = 0 THEN NULL ELSE CAST(embedding[1] AS DOUBLE) END AS d0,
  CASE WHEN vec_id % 11 = 0 THEN NULL ELSE CAST(embedding[2] AS DOUBLE) END AS d1,
  {", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS d{i}" for i in range(2, BM_DIMS))}, label
FROM embeddings"""


def frame_C(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return (e.groupBy(F.col("user_id").alias("feature"), F.col("event_type").alias("option"))
            .agg((F.avg("value") / 50).alias("logit"))
            .withColumn("stage", F.lit(1)))


SQL_C = """SELECT user_id AS feature, event_type AS option, avg(value) / 50 AS logit, 1 AS stage
FROM events GROUP BY user_id, event_type"""


def frame_H(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return (e.groupBy(F.col("event_type").alias("trial"), F.dayofmonth("ts").alias("epoch"))
            .agg(F.avg("value").alias("val_loss"),
                 F.avg(F.when(F.col("value") < 35, 1.0).otherwise(0.0)).alias("val_acc")))


SQL_H = """SELECT event_type AS trial, CAST(day(ts) AS INTEGER) AS epoch, avg(value) AS val_loss,
  avg(CASE WHEN value < 35 THEN 1.0 ELSE 0.0 END) AS val_acc
FROM events GROUP BY event_type, day(ts)"""


def frame_Q(spark, sf_dir) -> DataFrame:
    """Document-quality classification: documents joined to their labels."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), "lang", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id")


SQL_Q = """SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS n_chars, d.lang, d.source, l.quality
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def sql_split(base_sql: str, key: str, seed: int = 1) -> str:
    """The split tag in SQL: first floor(.2N) rows of the md5 order are test,
    the next floor(.2N) val."""
    return f"""SELECT * EXCLUDE (_rn, _nn),
  CASE WHEN _rn < floor(_nn * 0.2) THEN 'test'
       WHEN _rn < floor(_nn * 0.2) + floor(_nn * 0.2) THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('{seed}', ':', CAST({key} AS VARCHAR))), {key}) - 1 AS _rn,
             count(*) OVER () AS _nn FROM ({base_sql}))"""
