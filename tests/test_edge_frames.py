"""Hand-written edge frames: every statistic's corner case."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepforge.functions import stats as S
from prepforge.operators.discretize import Discretize
from prepforge.operators.encoding import Encode
from prepforge.operators.imputation import Impute
from prepforge.operators.outliers import RemoveOutliers, RepairOutliers
from prepforge.operators.scaling import Scale
from prepforge.operators.selection import SelectFeatures, top_k
from prepforge.sources import dataset as D


@pytest.fixture()
def quad(spark):
    return spark.createDataFrame([(1, 10.0, 5.0), (2, 20.0, 5.0), (3, 25.0, 5.0), (4, 70.0, 5.0)], "k long, x double, c double")


def test_population_std_and_constant(spark, quad):
    f = Scale("standard").fit(quad, ["x", "c"])
    m, s = f.params["affine"]["x"]
    assert m == pytest.approx(31.25)
    assert s == pytest.approx(np.std([10, 20, 25, 70]))            # population std
    assert f.params["affine"]["c"][1] == 1.0                        # constant -> divide by 1
    out = f.transform(quad).select("c").collect()
    assert all(r[0] == 0.0 for r in out)


def test_median_quartiles_linear(spark, quad):
    q = S.quantiles(quad, ["k"], [0.25, 0.5, 0.75])["k"]
    assert q == pytest.approx([1.75, 2.5, 3.25])


@pytest.mark.parametrize(("buckets", "finish", "ranges"), [(4096, 4096, 512), (16, 3, 512), (8, 1, 2)])
def test_order_statistics_match_numpy(spark, monkeypatch, buckets, finish, ranges):
    """Hot values, any spread, signed zeros, missing values; few buckets force many passes."""
    monkeypatch.setattr(S, "BUCKETS", buckets)
    monkeypatch.setattr(S, "FINISH_ROWS", finish)
    monkeypatch.setattr(S, "PASS_RANGES", ranges)
    rng = np.random.default_rng(0)
    n = 900
    cols = {"a": np.concatenate([rng.normal(size=600), np.full(300, 7.0)]),          # a hot value: a third of the rows
            "b": 10.0 ** rng.integers(-300, 300, n) * rng.choice([-1, 1], n), "c": rng.integers(0, 3, n) * 1.0, "d": np.where(rng.uniform(size=n) < 0.4, np.nan, rng.uniform(size=n)),
            "e": np.where(rng.uniform(size=n) < 0.5, -0.0, 0.0), "f": np.full(n, np.nan)}
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*cols.values(), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(3)
    probs = [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]
    got = S.quantiles(df, list(cols), probs)
    for c, v in cols.items():
        v = v[~np.isnan(v)]
        assert got[c] == ([None] * len(probs) if not len(v) else pytest.approx(np.percentile(v, [100 * p for p in probs]).tolist(), rel=1e-12)), c


def test_order_statistics_of_many_columns(spark):
    """200 columns, 20 cuts each, against DuckDB; what comes to the driver is a value a cut."""
    import duckdb
    df = spark.range(6000, numPartitions=4).select(*[((F.xxhash64("id", F.lit(i)) % 100_000) / (i + 1)).alias(f"c{i}") for i in range(200)])
    cuts = [i / 21 for i in range(1, 21)]
    got = S.quantiles(df, df.columns, cuts)
    t = df.toArrow()  # noqa: F841
    want = duckdb.sql("SELECT " + ", ".join(f"quantile_cont(c{i}, {cuts}) AS c{i}" for i in range(200)) + " FROM t").fetchall()[0]
    for i in range(200):
        assert got[f"c{i}"] == pytest.approx(want[i], rel=1e-9)


def test_mode_tie_smallest_missing_ignored(spark):
    df = spark.createDataFrame([(2.0,), (1.0,), (1.0,), (2.0,), (None,), (9.0,)], "x double")
    assert S.modes(df, ["x"])["x"] == 1.0
    f = Impute("most_frequent").fit(df, ["x"])
    assert f.params["fill"]["x"] == 1.0


def test_onehot_vocab_null_unseen(spark):
    tr = spark.createDataFrame([("b",), ("a",), ("b",), ("c",), (None,)], "s string")
    f = Encode("onehot").fit(tr, ["s"])
    assert f.params["vocab"]["s"] == ["a", "b", "c", None]
    te = spark.createDataFrame([("z",), (None,), ("a",)], "s string")
    out = f.transform(te).select("s_a", "s_b", "s_c", "s_nan").collect()
    assert [tuple(r) for r in out] == [(0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 0.0, 1.0), (1.0, 0.0, 0.0, 0.0)]


def test_ordinal_unseen_missing_codes(spark):
    tr = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b")], "k long, s string")
    f = Encode("ordinal", key="k").fit(tr, ["s"])
    te = spark.createDataFrame([(9, "a"), (10, "z"), (11, None), (12, "b")], "k long, s string")
    got = [r[0] for r in f.transform(te).orderBy("k").select("s").collect()]
    assert got == [2.0, -1.0, -2.0, 1.0]                                # b first seen -> 1


def test_binary_digits(spark):
    tr = spark.createDataFrame([(i, v) for i, v in enumerate("abcde")], "k long, s string")
    f = Encode("binary", key="k").fit(tr, ["s"])
    out = f.transform(tr).orderBy("k").select("s_0", "s_1", "s_2").collect()
    assert [tuple(int(x) for x in r) for r in out] == [(0, 0, 1), (0, 1, 0), (0, 1, 1), (1, 0, 0), (1, 0, 1)]


def test_na_tokens_before_inference(spark):
    df = spark.createDataFrame([("",), ("NA",), ("nan",), ("?",), ("3",)], "v string")
    spec = D.DatasetSpec(label="v", missing_value="?")
    out = D.infer_types(D.null_tokens(df, spec.tokens()))
    assert dict(out.dtypes)["v"] == "double"
    assert [r[0] for r in out.collect()] == [None, None, None, None, 3.0]


def test_all_missing_in_train_dropped(spark):
    df = spark.createDataFrame([("train", None, 1.0), ("val", 2.0, 1.0)], "split string, a double, b double")
    out, dead = D.drop_all_missing(df, ["a", "b"], where=F.col("split") == "train")
    assert dead == ["a"] and out.columns == ["split", "b"]


def test_large_categorical_boundary(spark):
    df = spark.createDataFrame([(f"x{i}", f"y{min(i, 999)}") for i in range(1001)], "a string, b string")
    assert D.large_categoricals(df, ["a", "b"]) == ["a"]       # 1001 distinct dropped, 1000 kept


def test_constant_cluster_outliers(spark):
    vals = [5.0] * 20 + [100.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k long, x double")
    z = RemoveOutliers("zscore").fit(df, ["x"])
    assert z.transform(df).count() == 20                              # far value removed
    iqr = RemoveOutliers("iqr").fit(df, ["x"])
    assert iqr.params["bounds"] == {}                                 # IQR = 0 -> column not tested
    assert iqr.transform(df).count() == 21
    mad = RepairOutliers("MAD_2.5").fit(df, ["x"])
    lo, hi, fill = mad.params["bounds"]["x"]
    assert lo == hi == 5.0 and fill == 5.0                            # MAD = 0
    assert [r[0] for r in mad.transform(df).select("x").collect()] == [5.0] * 21


def test_rare_class_filter(spark):
    df = spark.createDataFrame([("a",)] * 4 + [("b",)] * 5, "y string")
    out = D.rare_class_filter(df, "y")
    assert sorted(set(r[0] for r in out.collect())) == ["b"] and out.count() == 5


def test_task_type_boundary(spark):
    df50 = spark.createDataFrame([(float(i % 50),) for i in range(200)], "y double")
    df51 = spark.createDataFrame([(float(i % 51),) for i in range(200)], "y double")
    assert D.detect_task_type(df50, "y") == "classification"
    assert D.detect_task_type(df51, "y") == "regression"


def test_clip_and_bin_edges(spark):
    tr = spark.createDataFrame([(0.0,), (10.0,)], "x double")
    te = spark.createDataFrame([(-5.0,), (0.0,), (9.99,), (10.0,), (50.0,), (None,)], "x double")
    mm = Scale("minmax_clip").fit(tr, ["x"])
    assert [r[0] for r in mm.transform(te).collect()] == [0.0, 0.0, pytest.approx(0.999), 1.0, 1.0, None]
    b = Discretize("uniform_5").fit(tr, ["x"])
    assert [r[0] for r in b.transform(te).collect()] == [0.0, 0.0, 4.0, 4.0, 4.0, None]


def test_quantile_bins_match_reference_rule(spark):
    vals = [float(v) for v in [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9]]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    f = Discretize("quantile_5").fit(df, ["x"])
    srt = np.sort(vals)
    step = round(len(vals) / 5)
    cuts = srt[np.arange(step - 1, len(vals) - 1, step)]
    assert f.params["cuts"]["x"] == pytest.approx(cuts.tolist())
    want = np.clip((np.array(vals)[:, None] > cuts[None, :]).sum(1), 0, 4)
    assert [r[0] for r in f.transform(df).collect()] == want.tolist()


def test_variance_threshold_population(spark):
    # population variance 0.009 is NOT kept at threshold 0.01 (sample variance 0.018 would be)
    df = spark.createDataFrame([(0.0, 0.0), (0.19, 1.0)], "a double, b double")
    f = SelectFeatures("variance_threshold").fit(df, ["a", "b"])
    assert f.params["keep"] == ["b"]


def test_topk_ties_keep_later_and_nan_last():
    cols = ["a", "b", "c", "d"]
    assert top_k({"a": 1.0, "b": 1.0, "c": float("nan"), "d": 0.5}, cols, 1) == ["b"]
    assert top_k({"a": 1.0, "b": 1.0, "c": float("nan"), "d": 0.5}, cols, 3) == ["a", "b", "d"]


def test_anova_matches_formula(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 200)
    x = rng.normal(size=200) + y
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    from prepforge.operators.selection import anova_f
    got = anova_f(df, ["x"], "y")["x"]
    groups = [x[y == k] for k in range(3)]
    grand = x.mean()
    ssb = sum(len(g) * (g.mean() - grand) ** 2 for g in groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    assert got == pytest.approx((ssb / 2) / (ssw / (200 - 3)))


def test_partition_independence(spark):
    from prepforge.operators.split import tag_split
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey")
    a = sorted(tuple(r) for r in tag_split(o.repartition(1), "o_orderkey").collect())
    b = sorted(tuple(r) for r in tag_split(o.repartition(7), "o_orderkey").collect())
    assert a == b
    n = len(a)
    counts = {s: sum(1 for _, x in a if x == s) for s in ("train", "val", "test")}
    assert counts["test"] == int(n * 0.2) and counts["val"] == int(n * 0.2)
    assert counts["train"] == n - 2 * int(n * 0.2)


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    out = D.null_tokens(df, [])
    assert [r[0] for r in out.collect()] == [None, 1.0]
    assert not math.isnan(S.agg_row(out, {"m": F.avg("x")})["m"])


def test_vocabulary_tables_against_python(spark):
    rows = [(i, None if i % 9 == 0 else f"v{i % 13}") for i in range(200)]
    df = spark.createDataFrame(rows, "k long, s string")
    n = Counter(v for _, v in rows)
    code = {v: i + 1.0 for i, v in enumerate(dict.fromkeys(v for _, v in rows if v is not None))} | {None: -2.0}
    for m, want in (("count", n), ("frequency", {v: x / 200 for v, x in n.items()}), ("ordinal", code)):
        f = Encode(m, key="k").fit(df, ["s"])
        got = {r["k"]: r["s"] for r in f.transform(df).select("k", "s").collect()}
        assert got == {k: want[v] for k, v in rows}, m


def test_encoders_of_several_columns_save_and_reload(spark, tmp_path):
    from prepforge.sources.sinks import load_model, save_model
    df = spark.createDataFrame([(1, "b", "x", 7), (2, None, "y", 8), (3, "a", "y", 7), (4, "b", None, 9)], "k long, a string, B string, _n int")
    for m in ("frequency", "count", "ordinal", "binary"):
        f = Encode(m, key="k").fit(df, ["a", "B"])
        save_model(spark, [("encoding", f)], str(tmp_path / m))
        (_, g), = load_model(spark, str(tmp_path / m))
        new = df.unionByName(spark.createDataFrame([(5, "zz", None, 1)], df.schema))
        assert sorted(map(tuple, f.transform(new).collect())) == sorted(map(tuple, g.transform(new).collect()))
    got = {r["k"]: (r["a"], r["B"]) for r in Encode("ordinal", key="k").fit(df, ["a", "B"]).transform(new).collect()}
    assert got == {1: (1.0, 1.0), 2: (-2.0, 2.0), 3: (2.0, 2.0), 4: (1.0, -2.0), 5: (-1.0, -2.0)}
    empty = Encode("ordinal").fit(df.limit(0), ["a"]).transform(df)
    assert sorted(r["a"] for r in empty.collect()) == [-2.0, -1.0, -1.0, -1.0]


def test_ntile_matches_definition(spark):
    from prepforge.plans.catalog import ntile_positions
    df = spark.range(0, 103).withColumnRenamed("id", "k")
    got = {r["k"]: r["chunk"] for r in ntile_positions(df, "k", 7).collect()}
    sizes = [len(a) for a in np.array_split(np.arange(103), 7)]
    want, i = {}, 0
    for c, sz in enumerate(sizes):
        for _ in range(sz):
            want[i] = c
            i += 1
    assert got == want
