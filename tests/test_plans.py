"""Pipelines, search helpers, history rules and streaming application."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepforge.plans import choices as CH
from prepforge.plans import history as HI
from prepforge.plans.evaluate import expand_grid
from prepforge.plans.pipeline import PrepPipeline
from prepforge.plans.space import SPACE_B, SpacePipeline, default_choices, hard_choices, random_choices
from prepforge.suite.frames import frame_E, frame_H
from prepforge.operators.split import tag_split

SF = "/root/testdata/sf0.001"


def test_random_choice_is_explicit_pipeline(spark):
    df = tag_split(frame_E(spark, SF), "event_id")
    num, cat = ["value_m", "user_m"], ["type_m"]
    ch = random_choices(SPACE_B, num, cat, seed=11)
    assert ch == random_choices(SPACE_B, num, cat, seed=11)            # seeded
    picked = [[max(range(len(p)), key=p.__getitem__) for p in c.values()] for c in ch]
    for stage_choice in picked[1:]:
        assert len(set(stage_choice)) == 1                              # same option for all features
    pf = random_choices(SPACE_B, num, cat, seed=11, per_feature=True)
    assert len(pf) == len(SPACE_B)
    _ = df


def test_mixture_is_weighted_sum(spark):
    df = tag_split(frame_E(spark, SF), "event_id")
    num, cat = ["value_m", "user_m"], ["type_m"]
    base = default_choices(SPACE_B, num, cat)
    std = SpacePipeline(SPACE_B, base).fit(df, num + cat, "event_type", "split", key="event_id")
    mm_ch = default_choices(SPACE_B, num, cat)
    for f in num + cat:
        mm_ch[1][f] = [0, 0, 1.0, 0, 0]
    mm = SpacePipeline(SPACE_B, mm_ch).fit(df, num + cat, "event_type", "split", key="event_id")
    mix_ch = default_choices(SPACE_B, num, cat)
    for f in num + cat:
        mix_ch[1][f] = [0, 0.25, 0.75, 0, 0]
    mix = SpacePipeline(SPACE_B, mix_ch).fit(df, num + cat, "event_type", "split", key="event_id")
    a = {r["event_id"]: r["value_m"] for r in std.transform(df).collect()}
    b = {r["event_id"]: r["value_m"] for r in mm.transform(df).collect()}
    c = {r["event_id"]: r["value_m"] for r in mix.transform(df).collect()}
    for k in a:
        assert c[k] == pytest.approx(0.25 * a[k] + 0.75 * b[k])


def test_hard_choices_first_on_tie():
    assert hard_choices([{"f": [0.4, 0.4, 0.2]}]) == [{"f": [1.0, 0.0, 0.0]}]


def test_step_order_changes_statistics(spark):
    df = tag_split(frame_E(spark, SF), "event_id")
    cfg = {"imputation": "median", "encoding": "count", "outlier_removal": "iqr", "scaling": "robust"}
    m0 = PrepPipeline(cfg).fit(df, ["value_m", "user_m", "type_m"], "event_type", "split")
    m1 = PrepPipeline(cfg, order=1).fit(df, ["value_m", "user_m", "type_m"], "event_type", "split")
    assert [s for s, _ in m0.steps] == ["imputation", "scaling", "encoding", "outlier_removal"]
    assert [s for s, _ in m1.steps] == ["imputation", "encoding", "outlier_removal", "scaling"]


def test_sinkhorn_doubly_stochastic(spark):
    rng = np.random.default_rng(0)
    rows = [(f, i, j, float(rng.normal())) for f in range(3) for i in range(4) for j in range(4)]
    alpha = spark.createDataFrame(rows, "feature int, position int, stage_idx int, logit double")
    out = CH.sinkhorn(alpha).toPandas()
    for _, g in out.groupby("feature"):
        m = g.pivot(index="position", columns="stage_idx", values="prob").to_numpy()
        assert np.allclose(m.sum(0), 1, atol=1e-5) and np.allclose(m.sum(1), 1, atol=1e-5)


def _replay(records, interval=1, patience=3, gain=0.001):
    best_loss, best_acc, best_ep, last, pat = float("inf"), None, None, float("-inf"), patience
    for ep, loss, acc in sorted(records):
        if loss < best_loss:
            best_loss, best_acc, best_ep = loss, acc, ep
        if ep % interval == 0:
            if best_acc - last < gain:
                pat -= 1
            else:
                last, pat = best_acc, patience
        if pat <= 0:
            return ep, best_ep, best_acc
    return None, best_ep, best_acc


def test_early_stop_replay(spark):
    h = frame_H(spark, SF)
    got = {r["trial"]: (r["stop_epoch"], r["best_epoch"], r["best_val_acc"]) for r in HI.early_stop(h).collect()}
    recs = {}
    for r in h.collect():
        recs.setdefault(r["trial"], []).append((r["epoch"], r["val_loss"], r["val_acc"]))
    for t, rr in recs.items():
        want = _replay(rr)
        assert got[t][0] == want[0] and got[t][1] == want[1]


def test_expand_grid_order():
    assert expand_grid({"a": [1, 2], "b": 3, "c": ["x", "y"]}) == [
        {"a": 1, "b": 3, "c": "x"}, {"a": 1, "b": 3, "c": "y"}, {"a": 2, "b": 3, "c": "x"}, {"a": 2, "b": 3, "c": "y"}]


def test_fitted_model_applies_to_stream(spark, tmp_path):
    """A fitted pipeline is plain column expressions: the same model runs on
    a streaming DataFrame read from a file source."""
    df = tag_split(frame_E(spark, SF), "event_id")
    model = PrepPipeline({"imputation": "mean", "scaling": "standard", "encoding": "onehot"}).fit(
        df, ["value_m", "user_m", "type_m"], "event_type", "split")
    src = tmp_path / "in"
    df.drop("split").write.parquet(str(src))
    from prepforge.streaming.apply import start_prepared
    stream = spark.readStream.schema(df.drop("split").schema).parquet(str(src))
    q = start_prepared(model, stream, ["event_id"], sink="memory", name="prepared_stream",
                       checkpoint=str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM prepared_stream")
    batch = model.transform(df.drop("split"), keep=["event_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    _ = F


def test_model_save_load_roundtrip(spark, tmp_path):
    from prepforge.sources.sinks import load_model, save_model, space_table
    df = tag_split(frame_E(spark, SF), "event_id")
    model = PrepPipeline({"imputation": "median", "scaling": "robust", "encoding": "onehot"}).fit(
        df, ["value_m", "user_m", "type_m"], "event_type", "split")
    save_model(spark, model.steps, str(tmp_path / "m"))
    steps = load_model(spark, str(tmp_path / "m"))
    a = df
    for _, f in model.steps:
        a = f.transform(a)
    b = df
    for _, f in steps:
        b = f.transform(b)
    cols = ["event_id"] + model.output_cols
    assert sorted(map(tuple, a.select(*cols).collect())) == sorted(map(tuple, b.select(*cols).collect()))
    assert space_table(spark, SPACE_B).count() == sum(len(s.options) for s in SPACE_B) + len(SPACE_B[0].cat_options)


def test_sinkhorn_backward_matches_finite_difference():
    from prepforge.plans.gradient import sinkhorn_backward, sinkhorn_np
    rng = np.random.default_rng(2)
    a = rng.normal(size=(3, 3))
    w = rng.normal(size=(3, 3))
    m, tr = sinkhorn_np(a, iters=50, tol=0.0)
    g = sinkhorn_backward(tr, w)
    eps = 1e-6
    for i in range(3):
        for j in range(3):
            ap, am = a.copy(), a.copy()
            ap[i, j] += eps
            am[i, j] -= eps
            fd = ((sinkhorn_np(ap, iters=50, tol=0.0)[0] * w).sum() - (sinkhorn_np(am, iters=50, tol=0.0)[0] * w).sum()) / (2 * eps)
            assert g[i, j] == pytest.approx(fd, abs=1e-5)


def test_global_positions_over_many_slices(spark):
    """Counts and positions come from the same slices, whatever the bounds."""
    from pyspark.sql import functions as F
    from prepforge.plans.catalog import global_positions, ntile_positions
    df = spark.range(1_000_000, numPartitions=16).select(F.pmod(F.xxhash64("id"), F.lit(10 ** 9)).alias("k"), "id")
    pos, n = global_positions(df, ["k", "id"], slice_rows=40_000)
    assert n == 1_000_000
    bad = pos.agg(F.countDistinct("_pos").alias("d"), F.min("_pos").alias("lo"), F.max("_pos").alias("hi")).first()
    assert tuple(bad) == (1_000_000, 0, 999_999)
    from pyspark.sql import Window
    part = pos.where("_pos < 2000")
    w = Window.orderBy("k", "id")
    assert part.withColumn("r", F.row_number().over(w) - 1).where("r <> _pos").count() == 0
    x = spark.range(1003).select(F.col("id").alias("v"))
    assert ntile_positions(x, "v", 10).groupBy("chunk").count().count() == 10


def test_ordinal_codes_of_a_large_vocabulary(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import Window
    from prepforge.operators.encoding import Encode
    df = spark.range(100_000).select("id", F.concat(F.lit("c"), F.pmod(F.xxhash64("id"), F.lit(50_000)).cast("string")).alias("c"))
    got = Encode("ordinal").fit(df, ["c"]).transform(df.withColumn("raw", F.col("c"))).select("raw", "c").distinct()
    want = df.select(F.col("c").alias("raw")).distinct().withColumn("r", F.row_number().over(Window.orderBy("raw")).cast("double"))
    assert got.count() == want.count() > 40_000
    assert got.join(want, "raw").where("c <> r").count() == 0


def test_single_option_prior_and_index_ties(spark):
    from prepforge.plans.choices import argmax, choice_prior
    one = spark.createDataFrame([(1, "f", "only"), (1, "g", "a"), (1, "g", "b")], "stage int, feature string, option string")
    got = {(r["feature"], r["option"]): r["prob"] for r in choice_prior(one, "a").collect()}
    assert got == {("f", "only"): 1.0, ("g", "a"): 0.5, ("g", "b"): 0.5}
    tie = spark.createDataFrame([(1, "f", "z", 0, 1.0), (1, "f", "a", 1, 1.0)], "stage int, feature string, option string, option_index int, logit double")
    assert argmax(tie).first()["option"] == "z"


def test_unsavable_steps_are_refused(spark, tmp_path):
    import pytest
    from prepforge.plans.pipeline import PrepPipeline
    from prepforge.sources.sinks import save_model
    df = spark.createDataFrame([(i, float(i % 7), None if i % 5 == 0 else float(i)) for i in range(60)], "k long, a double, b double")
    model = PrepPipeline({"imputation": "knn", "outlier_removal": "isolation_forest"}).fit(df, ["a", "b"], key="k")
    assert model.transform(df).where("b is null").count() == 0
    with pytest.raises(TypeError, match="can't be saved"):
        save_model(spark, model.steps, str(tmp_path / "m"))


def test_em_keeps_other_columns(spark):
    from prepforge.operators.model_impute import EMImpute
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big + i, None if i == 3 else big, float(i), None if i % 4 == 0 else 2.0 * i) for i in range(40)], "k long, w long, a double, b double")
    out = EMImpute("em").fit(df, ["a", "b"]).transform(df)
    assert out.where("b is null").count() == 0 and dict(out.dtypes)["w"] == "bigint"
    assert sorted(r["w"] or 0 for r in out.collect()) == sorted([0] + [big] * 39)


def test_sparse_onehot_of_a_hundred_thousand_categories(spark, tmp_path):
    """Encodes, saves and reloads; unseen and missing categories."""
    from pyspark.sql import functions as F
    from prepforge.operators.encoding import Encode
    from prepforge.sources.sinks import load_model, save_model
    df = spark.range(120_000).select("id", F.when(F.col("id") < 110_000, F.format_string("c%06d", F.col("id") % 100_000)).alias("s"), F.lit("a").alias("t"))
    fitted = Encode("onehot_sparse").fit(df, ["s", "t"])
    save_model(spark, [("encoding", fitted)], str(tmp_path / "m"))
    again = load_model(spark.newSession(), str(tmp_path / "m"))[0][1]
    rows = spark.createDataFrame([(0, "c000000", "a"), (1, "c099999", "b"), (2, "new", None), (3, None, "a")], "id long, s string, t string")
    for f in (fitted, again):
        got = {r["id"]: (r["s"], r["t"]) for r in f.transform(rows).collect()}
        assert {s.size for s, _ in got.values()} == {100_001} and {t.size for _, t in got.values()} == {1}
        assert [list(got[i][0].indices) for i in range(4)] == [[0], [99_999], [], [100_000]]
        assert [list(got[i][1].indices) for i in range(4)] == [[0], [], [], [0]]


def test_sparse_onehot_query_keeps_vectors_sparse(spark, tmp_path):
    """The slots of the query, without an array as wide as the categories in each row."""
    import os

    import __spark_entry__ as entry
    d = str(tmp_path / "t")
    os.makedirs(d)
    spark.range(3000).selectExpr("id AS event_id", "id % 900 AS user_id").write.parquet(f"{d}/events.parquet")
    out = entry.queries()["encode_onehot_sparse"](spark, d)
    rows = out.collect()
    who = {i: f"u{i % 900}" if i % 11 else None for i in range(3000)}
    known = sorted({who[r["event_id"]] for r in rows if r["split"] == "train"} - {None}) + [None]
    place = {w: n for n, w in enumerate(known)}
    assert len(rows) == 3000
    assert all(r["slot"] == place.get(who[r["event_id"]], -1) and r["width"] == len(known) for r in rows)
    assert dict(out.dtypes)["slot"] == "int" and dict(out.dtypes)["width"] == "int"
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UDF(") == 1    # the encoder's own, none that fills an array
