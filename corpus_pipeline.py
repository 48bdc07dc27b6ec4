"""Cleaning pipeline over ``documents``: language identification (rejected
documents go), SimHash near-duplicates (one document of each group stays),
benchmark decontamination (hit documents go), secret scans (secrets are
masked), mixing to target weights (documents are repeated as planned).

Each stage takes whole rows and returns whole rows; columns that ``documents``
may have besides its usual ones pass through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prepforge.llm import decontam, langid, mixing, secretscan, simhash
from prepforge.llm.util import read_documents, store

STAGES = [
    ("language_id", langid.stage),
    ("simhash_dedup", simhash.stage),
    ("decontamination", decontam.stage),
    ("secret_scan", secretscan.stage),
    ("mixing", mixing.stage),
]

#: SQL can't express zstandard compression; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder."""
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
