"""Spark session helpers.

Library code never creates its own session on a cluster: every operator takes
the session of the DataFrame it is given. ``local_session`` exists for tests,
the bench and the driver smoke check only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Tunables read from the session conf (``spark.conf.set(key, value)``), with
# the defaults below. They bound what may be held by one task or the driver.
CONF_DEFAULTS = {
    # rows of a cell's block, and queries of a slice, in the exact kNN
    "prepforge.knn.blockRows": "4096",
}


def conf(spark: SparkSession, key: str) -> str:
    return spark.conf.get(key, CONF_DEFAULTS[key])


def conf_int(spark: SparkSession, key: str) -> int:
    return int(float(conf(spark, key)))


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "prepforge") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PREPFORGE_DRIVER_MEMORY", "16g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Only a local
    master, whose driver and executors share one machine, gets a scratch
    folder where the setting is missing; elsewhere that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="prepforge-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if _CHECKPOINT_DIRS.get(spark.sparkContext.applicationId) != d:
        spark.sparkContext.setCheckpointDir(d)
        _CHECKPOINT_DIRS[spark.sparkContext.applicationId] = d
    return d


#: The folder set for each application, so that it is set once.
_CHECKPOINT_DIRS: dict[str, str] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder: survives the loss
    of executors, unlike a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read
    back: its size is then known from its files, so joins with it choose
    their side by bytes, and nothing is computed twice."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
