"""A sample of registered queries against their DuckDB oracles at sf0.001
(the full gate at sf0.01 is tools/oracle_check.py)."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, digest

SF = "/root/testdata/sf0.001"
SAMPLE = ["split_train_val_test", "subsample", "impute_median", "impute_mode_num", "scale_robust", "encode_onehot",
          "encode_ordinal", "remove_iqr", "repair_mad", "bin_quantile", "select_anova", "prep_default",
          "prep_mixture", "impute_knn", "choice_softmax", "best_epoch", "ntile_tasks", "rare_class"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]
