"""Gradient search: kernel, gradients, order, sampling."""

import numpy as np
import pytest

from prepforge.operators.base import make_op
from prepforge.plans import gradient as G
from prepforge.plans.kernel import Form, fit_form, numeric_form, run
from prepforge.plans.space import SPACE_A, SPACE_B, SpacePipeline, Stage, default_choices

SMOOTH = [SPACE_A[0],
          Stage("normalization", SPACE_A[1].options, 0),
          Stage("cleaning_outliers", [o for o in SPACE_A[2].options if o[1] in ("ZS_2", "IQR_1", "identity")], 2),
          Stage("discretization", [o for o in SPACE_A[3].options if o[1] in ("quantile_5", "identity")], 1)]


def problem(seed=1, n=40, space=SMOOTH):
    """Alternatives of two numeric and one encoded categorical feature."""
    rng = np.random.default_rng(seed)
    slots = max(len(space[0].options), len(space[0].cat_options))
    a = rng.normal(size=(n, 4, slots)) * [[[1], [3], [1], [1]]]
    a[:, 2:, len(space[0].cat_options):] = 0.0
    y = (a[:, 0, 0] + rng.normal(size=n) > 0).astype(int) + (rng.uniform(size=n) > 0.8)
    theta = G.prior_logits(space, ["x", "z"], ["c"], random_init=True, seed=seed)
    feats, src = ["x", "z", "c_a", "c_b"], {"x": "x", "z": "z", "c_a": "c", "c_b": "c"}
    alpha = {f: rng.normal(size=(len(space) - 1,) * 2) for f in feats}
    model = (rng.normal(size=(3, 4)), rng.normal(size=3))
    return a, y, theta, alpha, feats, src, model


def planned(space, theta, alpha, feats, src, forms, noise=None):
    """The plan with fixed statistics (``forms`` by position and stage)."""
    placed = {f: G.sinkhorn_np(m, 400, 0.0) for f, m in alpha.items()} if alpha else None
    draw = G.Draw(theta, noise, 0.7)
    plan = G.build_plan(space, draw, feats, src, {f: m for f, (m, _) in placed.items()} if placed else None,
                        lambda p, pos, options: forms[pos, options[0][0]])
    return draw, plan._replace(slope_limit=None), {f: t for f, (_, t) in placed.items()} if placed else None


def fitted_forms(space, theta, alpha, feats, src, a, y):
    """Statistics fitted once, as the gradient's constants."""
    forms = {}

    def fit(plan, pos, options):
        forms[pos, options[0][0]] = [fit_form(s, m, kw, plan.forward(a, pos), y) for s, m, kw in options]
        return forms[pos, options[0][0]]

    orders = {f: G.sinkhorn_np(m, 400, 0.0)[0] for f, m in alpha.items()} if alpha else None
    G.build_plan(space, G.Draw(theta, None, 1.0), feats, src, orders, fit)
    return forms


def numeric(f, x, eps=1e-6):
    out = np.zeros_like(x)
    for i in np.ndindex(x.shape):
        old = x[i]
        x[i] = old + eps
        up = f()
        x[i] = old - eps
        out[i] = (up - f()) / (2 * eps)
        x[i] = old
    return out


@pytest.mark.parametrize("flexible", [False, True])
def test_gradients_match_finite_differences(flexible):
    a, y, theta, alpha, feats, src, model = problem()
    alpha = alpha if flexible else None
    forms = fitted_forms(SMOOTH, theta, alpha, feats, src, *problem(11)[:2])  # no row lies on a breakpoint

    def loss():
        _, plan, _ = planned(SMOOTH, theta, alpha, feats, src, forms)
        s = run(plan, a, y, *model, False)
        return s.loss / s.n

    draw, plan, traces = planned(SMOOTH, theta, alpha, feats, src, forms)
    s = run(plan, a, y, *model)
    g_theta, g_alpha = G.pipeline_gradient(s, plan, draw, feats, src, traces, len(SMOOTH) - 1)
    for k, st in enumerate(theta):
        for f in st:
            assert np.allclose(g_theta[k][f], numeric(loss, st[f]), atol=1e-6), (k, f)
    for f in alpha or {}:
        assert np.allclose(g_alpha[f], numeric(loss, alpha[f]), atol=1e-6)
    assert np.allclose(s.w / s.n, numeric(loss, model[0]), atol=1e-6) and np.allclose(s.b / s.n, numeric(loss, model[1]), atol=1e-6)


def test_second_order_matches_the_inner_step():
    """d L_val(w - lr * dL_train/dw(theta), theta) / d theta, by differences."""
    a, y, theta, _, feats, src, model = problem(3, 60)
    va, vy = problem(4, 50)[:2]
    forms = fitted_forms(SMOOTH, theta, None, feats, src, *problem(12)[:2])
    lr = 0.5

    def after():
        _, plan, _ = planned(SMOOTH, theta, None, feats, src, forms)
        s = run(plan, a, y, *model, False)
        v = run(plan, va, vy, model[0] - lr * s.w / s.n, model[1] - lr * s.b / s.n, False)
        return v.loss / v.n

    draw, plan, _ = planned(SMOOTH, theta, None, feats, src, forms)
    on = lambda x, t: lambda models: [run(plan, x, t, *m) for m in models]
    got = {order: G.pipeline_gradient(G.bilevel(on(va, vy), on(a, y), model, lr, order), plan, draw, feats, src, None, 3)[0] for order in (True, False)}
    for k, st in enumerate(theta):
        for f in st:
            want = numeric(after, st[f], 1e-5)
            assert np.allclose(got[True][k][f], want, atol=2e-5), (k, f)
    worst = max(np.abs(got[False][k][f] - got[True][k][f]).max() for k, st in enumerate(theta) for f in st)
    assert worst > 1e-3  # the term matters here


def test_sampled_choice_is_straight_through():
    _, _, theta, _, _, _, _ = problem()
    noise = G.gumbel_noise(theta, 7)
    draw = G.Draw(theta, noise, 0.1)
    for k, st in enumerate(theta):
        for f, v in st.items():
            assert sorted(draw.p[k][f]) == [0.0] * (len(v) - 1) + [1.0] and draw.p[k][f].argmax() == (v + noise[k][f]).argmax()
            c = np.arange(len(v)) ** 2.0
            soft = lambda v=v, k=k, f=f, c=c: float((G._softmax((v + noise[k][f]) / 0.1) * c).sum())
            assert np.allclose(draw.back(k, f, c), numeric(soft, v, 1e-7), atol=1e-4)
    assert all((G.gumbel_noise(theta, 7)[k][f] == noise[k][f]).all() for k, st in enumerate(theta) for f in st)


@pytest.mark.parametrize("space", [SPACE_A, SPACE_B])
def test_batch_fits_equal_the_operators(spark, space):
    """Every option: numbers fitted on a batch, the operator fitted by Spark,
    and the operator's own column expressions give the same values."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(57, 3)) * [1, 10, 0.05], 3)
    y = rng.integers(0, 3, 57)
    feats = ["u", "v", "w"]
    df = spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y, strict=True)], "u double, v double, w double, label int").coalesce(1)
    for st in space[1:]:
        for s, m, kw in st.options:
            if s == "outlier_removal":
                continue
            fitted = make_op(s, m, **kw).fit(df, feats, "label")
            want, slope = numeric_form(fitted, feats).values(x)
            got, again = fit_form(s, m, kw, x, y).values(x)
            assert np.allclose(got, want, atol=1e-8), (s, m)
            assert np.allclose(slope, again, atol=1e-8)
            from prepforge.plans.space import _option_exprs
            cols = df.select(*[c.cast("double").alias(f) for f, c in _option_exprs(fitted, feats)[0].items() if f in feats]).toPandas()[feats].to_numpy()
            assert np.allclose(cols, want, atol=1e-8), (s, m)


@pytest.fixture(scope="module")
def table(spark):
    from prepforge.operators.split import tag_split
    rng = np.random.default_rng(6)
    rows = [(i, float(np.exp(rng.normal())) if i % 9 else None, float(rng.normal()), "abc"[i % 3] if i % 7 else None) for i in range(400)]
    rows = [(*r, int((r[1] or 1.0) * (1 + (r[3] == "a")) + 0.3 * r[2] > 1.2)) for r in rows]
    return tag_split(spark.createDataFrame(rows, "id long, x double, z double, c string, label int"), "id")


ARGS = dict(feature_cols=["x", "z", "c"], label="label", space=SMOOTH, key="id")


def test_search_improves_and_repeats(table):
    first = G.gradient_search(table, iters=6, **ARGS)
    again = G.gradient_search(table.repartition(5), iters=6, **ARGS)
    assert first.history[-1]["val_loss"] < first.history[0]["val_loss"]
    assert first.best["val_loss"] == min(h["val_loss"] for h in first.history)
    assert all(np.allclose(first.theta[k][f], again.theta[k][f], atol=1e-6) for k, st in enumerate(first.theta) for f in st)
    record = G.search_result(first)
    assert record.best_val_loss == first.best["val_loss"] and 0 <= record.best_test_acc <= 1


def test_search_options(table):
    """Sampling, second order, all train rows, patience; each runs and learns."""
    for kw in (dict(sample=True), dict(second_order=True), dict(batch_rows=None), dict(flexible=True, second_order=True, sample=True)):
        s = G.gradient_search(table, iters=1, model_steps=1, **kw, **ARGS)
        start = G.prior_logits(SMOOTH, ["x", "z"], ["c"])
        assert any(not np.allclose(s.theta[k][f], start[k][f]) for k, st in enumerate(s.theta) for f in st)
        assert len(s.history) == 1 and np.isfinite([h["val_loss"] for h in s.history]).all()
    assert len(G.gradient_search(table, iters=6, patience=1, model_lr=30.0, model_steps=1, **ARGS).history) < 6


def test_learned_order_is_applied(spark, table):
    """The final dataset of a flexible search equals a hand-built one and differs from the fixed order."""
    state = G.gradient_search(table, iters=1, flexible=True, **ARGS)
    names = [st.name for st in SMOOTH[1:]]
    swap = np.array([[0.0, 0.0, 9.0], [0.0, 9.0, 0.0], [9.0, 0.0, 0.0]])  # x: bins, repair, scaling
    state.alpha["x"] = swap
    big = lambda n, i: np.where(np.arange(n) == i, 9.0, 0.0)
    for f in ("x", "z", "c"):
        state.theta[1][f], state.theta[2][f], state.theta[3][f] = big(4, 0), big(3, 2), big(2, 0)
    state.theta[0]["x"] = big(5, 0)
    assert G.stage_order(state, SMOOTH)["x"] == names[::-1] and G.stage_order(state, SMOOTH)["z"] == names
    model, out = G.final_dataset(table, ["x", "z", "c"], "label", SMOOTH, state, "id")
    got = {r["id"]: r for r in out.select("id", "split", "x", "z").collect()}
    rows = table.collect()
    train = [r for r in rows if r["split"] == "train"]

    def hand(col, order):
        seen = np.array([np.nan if r[col] is None else r[col] for r in train])
        low, high = np.nanmin(seen), np.nanmax(seen)
        fill = np.nanmean((seen - low) / (high - low))
        scale = lambda r: fill if r[col] is None else (r[col] - low) / (high - low)
        x, t = np.array([[scale(r)] for r in rows]), np.array([[scale(r)] for r in train])
        for s, m in order:
            form = fit_form(s, m, {}, t, np.zeros(len(t)))
            x, t = form.values(x)[0], form.values(t)[0]
        return x[:, 0]

    for col, order in (("x", [("discretization", "quantile_5"), ("scaling", "ZS")]), ("z", [("scaling", "ZS"), ("discretization", "quantile_5")])):
        want = hand(col, order)
        assert np.allclose([got[r["id"]][col] for r in rows], want, atol=1e-9)
    fixed = SpacePipeline(SMOOTH, G.final_choices(state)).fit(table, ["x", "z", "c"], "label", key="id").transform(table)
    assert any(abs(r["x"] - got[r["id"]]["x"]) > 0.5 for r in fixed.collect())


def test_default_order_unchanged(spark, table):
    order = {f: [st.name for st in SMOOTH[1:]] for f in ("x", "z", "c_a", "c_b", "c_c", "c_NA", "c_None")}
    choices = default_choices(SMOOTH, ["x", "z"], ["c"])
    a = SpacePipeline(SMOOTH, choices).fit(table, ["x", "z", "c"], "label", key="id")
    order = {f: [st.name for st in SMOOTH[1:]] for f in a.features}
    b = SpacePipeline(SMOOTH, choices, order=order).fit(table, ["x", "z", "c"], "label", key="id")
    cols = ["id", *a.features]
    assert sorted(a.transform(table).select(*cols).collect()) == sorted(b.transform(table).select(*cols).collect())


def test_forms_without_columns():
    assert Form("identity").values(np.zeros((3, 2)))[1].tolist() == [1.0, 1.0]


@pytest.mark.parametrize("name", ["random_search", "prep_random_per_feature"])
def test_pipelines_fit_on_rows_joined_and_split_once(spark, monkeypatch, name):
    """What the pipelines are fitted on is read back, not joined and split again by each of their jobs."""
    import __spark_entry__ as entry
    from prepforge.plans import space

    class Seen(Exception):
        pass

    def fit(self, df, *args, **kw):
        raise Seen(df._jdf.queryExecution().optimizedPlan().toString())

    monkeypatch.setattr(space.SpacePipeline, "fit", fit)
    with pytest.raises(Seen) as plan:
        entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert str(plan.value).startswith("Relation") and "Join" not in str(plan.value) and "Window" not in str(plan.value)


def test_random_search_runs_pipelines_side_by_side(spark, monkeypatch):
    """Each pipeline is prepared once, two at least at a time; the trials come in the order of the grid."""
    import threading

    from prepforge.plans import evaluate
    together, made = threading.Barrier(2), []

    def prepare(seed):
        made.append(seed)
        together.wait(60)
        return seed

    monkeypatch.setattr(evaluate, "score_vectors", lambda data, reg: (None, evaluate.RunResult(data, reg, 0.0, 0.0, 0.0, 0.0)))
    got = evaluate.random_search(spark, prepare, n=4, grid={"reg": [0.0, 0.5]}, seed=3).orderBy("trial").collect()
    assert sorted(made) == [3, 4, 5, 6]
    assert [(r["trial"], r["best_epoch"], r["best_val_loss"], r["status"]) for r in got] == [(2 * i + j, 3 + i, reg, "ok") for i in range(4) for j, reg in enumerate((0.0, 0.5))]


def test_random_search_failures(spark):
    """A failure is raised, or becomes the trials of its pipeline."""
    from prepforge.plans.evaluate import random_search

    def prepare(seed):
        raise ValueError(f"no {seed}")

    with pytest.raises(ValueError, match="no 0"):
        random_search(spark, prepare, n=2, grid={"reg": [0.0]})
    got = random_search(spark, prepare, n=2, grid={"reg": [0.0, 0.5]}, skip_failed=True).orderBy("trial").collect()
    assert [r["status"] for r in got] == ["failed: no 0", "failed: no 0", "failed: no 1", "failed: no 1"]
