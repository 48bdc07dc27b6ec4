"""Model-based operators against numpy brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepforge.operators.iforest import RemoveIsolationForest
from prepforge.functions import patterns
from prepforge.operators import model_impute as M
from prepforge.operators.model_impute import EMImpute, MiceImpute, TreeImpute, bayesian_ridge
from prepforge.operators.neighbors import KnnImpute, knn_approximate, knn_candidates, lof_scores, neighbour_search
from prepforge.operators.reduction import Reduce


def _frame(spark, x, with_nan=True):
    rows = [(i, *[None if (with_nan and np.isnan(v)) else float(v) for v in r]) for i, r in enumerate(x)]
    cols = ", ".join(f"c{j} double" for j in range(x.shape[1]))
    return spark.createDataFrame(rows, f"k long, {cols}")


def test_knn_candidates_blocked_equals_bruteforce(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4))
    df = _frame(spark, x, with_nan=False)
    spark.conf.set("prepforge.knn.blockRows", "5")           # cells of several blocks and slices
    try:
        got = knn_candidates(df, df, "k", "k", ["c0", "c1", "c2", "c3"], 3, exclude_self=True).collect()
    finally:
        spark.conf.unset("prepforge.knn.blockRows")
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for r in got:
        order = sorted(range(120), key=lambda j: (d[r["qk"], j], j))[:3]
        assert r["bk"] in order
    assert len(got) == 120 * 3


def test_cells_rule_out_most_tiles(spark):
    """Clustered rows: the same neighbours as by brute force, from a small part of the cells."""
    rng = np.random.default_rng(21)
    x = np.vstack([rng.normal(size=(40, 3)) * 0.1 + c for c in rng.normal(size=(30, 3)) * 20])
    x[5] = x[6]  # ties
    df = _frame(spark, x, with_nan=False)
    cand, index, need = neighbour_search(df, df, "k", "k", ["c0", "c1", "c2"], 4, exclude_self=True)
    got = {}
    for r in cand.collect():
        got.setdefault(r["qk"], []).append((r["dist"], r["bk"]))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        assert [b for _, b in sorted(got[i])] == sorted(range(len(x)), key=lambda j: (round(d[i, j], 6), j))[:4]
    searched = need.selectExpr("sum(size(need))").first()[0] + len(x)
    assert len(index.pivots) > 20 and searched < 0.2 * len(x) * len(index.pivots)


@pytest.mark.parametrize("block", ["7", "4096"])
def test_knn_impute_over_cells_and_blocks(spark, block):
    """Gaps in query and base, hot cells cut into blocks and slices, repeated rows."""
    rng = np.random.default_rng(22)
    x = np.vstack([rng.normal(size=(30, 4)) + c for c in ([0, 0, 0, 0], [30, 30, 30, 30], [60, 0, 60, 0])])
    x[60:75] = x[60]
    x[::5, 0] = np.nan
    x[1::7, 1] = np.nan
    x[0, :2] = np.nan
    df = _frame(spark, x)
    spark.conf.set("prepforge.knn.blockRows", block)
    try:
        got = {r["k"]: (r["c0"], r["c1"]) for r in KnnImpute("knn", key="k").fit(df, ["c0", "c1", "c2", "c3"]).transform(df).collect()}
    finally:
        spark.conf.unset("prepforge.knn.blockRows")
    for i in range(len(x)):
        for j in (0, 1):
            if np.isnan(x[i, j]):
                donors = []
                for b in np.flatnonzero(~np.isnan(x[:, j])):
                    m = ~np.isnan(x[i]) & ~np.isnan(x[b])
                    donors.append((round(np.sqrt(4.0 / m.sum() * ((x[i, m] - x[b, m]) ** 2).sum()), 9), b))
                want = np.mean([x[b, j] for _, b in sorted(donors)[:5]])
                assert got[i][j] == pytest.approx(want)


def test_neighbour_search_sends_little(spark, monkeypatch):
    """A query goes to groups of cells, not to each cell, and only candidates
    that can still be among the nearest come back; wide batches are compared
    with the pivots in slices."""
    from prepforge.operators import neighbors as N
    rng = np.random.default_rng(24)
    x = rng.normal(size=(900, 12))                       # nothing to rule out by distance
    df = _frame(spark, x, with_nan=False)
    cols, sent, seen = [f"c{j}" for j in range(12)], [], []
    search, distances = N.CellIndex.search, N._distances

    def counted(self, queries, *args):
        sent.append((self._asked(queries).count(), queries.selectExpr("sum(size(need))").first()[0]))
        out = search(self, queries, *args)
        sent[-1] += (out.count(),)
        return out

    monkeypatch.setattr(N.CellIndex, "search", counted)
    got = {}
    for r in knn_candidates(df, df, "k", "k", cols, 5, exclude_self=True).collect():
        got.setdefault(r["qk"], []).append((r["dist"], r["bk"]))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        assert [b for _, b in sorted(got[i])] == sorted(range(len(x)), key=lambda j: (d[i, j], j))[:5]
    (_, _, _), (copies, cells, back) = sent
    assert cells > 20 * len(x) and copies <= 2 * len(x) and back <= 5 * len(x)
    monkeypatch.setattr(N, "_distances", lambda a, b: seen.append(len(a)) or distances(a, b))
    index = N.CellIndex.__new__(N.CellIndex)
    index.metric, index.pivots = list(range(12)), x[:30]

    class Once:
        dtypes = [("bk", "bigint")]

        def mapInPandas(self, work, schema):
            return list(work([__import__("pandas").DataFrame({"bk": range(5000), "x": [x[0]] * 5000})]))

    (part,) = index.assigned(Once(), "bk")
    assert len(part) == 5000 and (part["cell"] == 0).all() and max(seen) <= N._SLICE


def test_rows_that_coincide_are_searched_a_few_times(spark):
    x = np.vstack([np.tile([[1.0, 2.0]], (300, 1)), np.arange(40).reshape(20, 2) + 10.0])
    df = _frame(spark, x, with_nan=False)
    cand, index, _ = neighbour_search(df, df, "k", "k", ["c0", "c1"], 3, exclude_self=True)
    got = {}
    for r in cand.collect():
        got.setdefault(r["qk"], []).append((r["dist"], r["bk"]))
    assert sorted(b for _, b in got[0]) == [1, 2, 3] and sorted(b for _, b in got[2]) == [0, 1, 3] and sorted(b for _, b in got[299]) == [0, 1, 2]
    assert index.base.count() <= 25 and len(got) == len(x) and all(len(v) == 3 for v in got.values())


def test_knn_without_a_complete_column(spark):
    x = np.array([[1.0, np.nan], [np.nan, 2.0], [1.5, 2.5], [3.0, 4.0]])
    got = {r["k"]: (r["c0"], r["c1"]) for r in KnnImpute("knn", key="k", k=1).fit(_frame(spark, x), ["c0", "c1"]).transform(_frame(spark, x)).collect()}
    assert got[0] == (1.0, 2.5) and got[1] == (1.5, 2.0)


def test_approximate_neighbours(spark):
    """LSH: true distances, and most of the true neighbours of clustered rows."""
    rng = np.random.default_rng(23)
    x = np.vstack([rng.normal(size=(30, 6)) * 0.2 + c for c in rng.normal(size=(8, 6)) * 10])
    df = _frame(spark, x, with_nan=False)
    cols = [f"c{j}" for j in range(6)]
    got = {(r["qk"], r["bk"]): r["dist"] for r in knn_approximate(df, df, "k", "k", cols, 5, 3.0, 2.0, exclude_self=True).collect()}
    want = {(r["qk"], r["bk"]): r["dist"] for r in knn_candidates(df, df, "k", "k", cols, 5, exclude_self=True).collect()}
    assert len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(got[x] == pytest.approx(want[x], abs=1e-6) for x in got.keys() & want.keys())


def test_knn_impute_matches_nan_euclidean(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    x[::7, 0] = np.nan
    x[3::11, 1] = np.nan
    df = _frame(spark, x)
    f = KnnImpute("knn", key="k").fit(df, ["c0", "c1", "c2"])
    got = {r["k"]: (r["c0"], r["c1"]) for r in f.transform(df).collect()}
    for i in range(60):
        for j in (0, 1):
            if not np.isnan(x[i, j]):
                continue
            mq = ~np.isnan(x[i])
            best = []
            for b in range(60):
                if np.isnan(x[b, j]):
                    continue
                m = mq & ~np.isnan(x[b])
                dd = np.sqrt(3.0 / m.sum() * ((x[i, m] - x[b, m]) ** 2).sum())
                best.append((dd, b))
            best.sort()
            want = np.mean([x[b, j] for _, b in best[:5]])
            assert got[i][j] == pytest.approx(want)


def test_lof_matches_bruteforce(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(80, 2)), [[6.0, 6.0]]])
    df = _frame(spark, x, with_nan=False)
    got = {r["k"]: r["lof"] for r in lof_scores(df, "k", ["c0", "c1"], 10).collect()}
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    nn = [sorted(range(n), key=lambda j: (d[i, j], j))[:10] for i in range(n)]
    kd = np.array([d[i, nn[i][-1]] for i in range(n)])
    lrd = np.array([1.0 / (np.mean([max(kd[j], d[i, j]) for j in nn[i]]) + 1e-10) for i in range(n)])
    lof = np.array([np.mean(lrd[nn[i]]) / lrd[i] for i in range(n)])
    for i in range(n):
        assert got[i] == pytest.approx(lof[i], rel=1e-9)
    assert got[80] > 1.5


def test_isolation_forest_removes_five_percent_and_planted(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(400, 3)), [[9.0, 9.0, 9.0]]])
    df = _frame(spark, x, with_nan=False)
    f = RemoveIsolationForest("isolation_forest", key="k").fit(df, ["c0", "c1", "c2"])
    kept = {r["k"] for r in f.transform(df).collect()}
    assert 400 not in kept
    assert abs((401 - len(kept)) - 0.05 * 401) <= 2


def test_bayesian_ridge_recovers_linear_model():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 3))
    y = x @ np.array([1.5, -2.0, 0.5]) + rng.normal(scale=0.01, size=500)
    xc, yc = x - x.mean(0), y - y.mean()
    coef = bayesian_ridge(xc.T @ xc, xc.T @ yc, float(yc @ yc), 500.0)
    assert coef == pytest.approx([1.5, -2.0, 0.5], abs=1e-2)


def test_mice_imputes_linear_structure(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=300)
    x = np.column_stack([a, 2 * a + rng.normal(scale=0.01, size=300), rng.normal(size=300)])
    x[::5, 1] = np.nan
    df = _frame(spark, x)
    out = {r["k"]: r["c1"] for r in MiceImpute("mice", key="k").fit(df, ["c0", "c1", "c2"]).transform(df).collect()}
    for i in range(0, 300, 5):
        assert out[i] == pytest.approx(2 * a[i], abs=0.05)


def _gappy(seed=12, n=240):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, 2))
    x = np.column_stack([z[:, 0] + 5, 2 * z[:, 0] + 0.3 * rng.normal(size=n), z[:, 1] * 100, z[:, 0] - z[:, 1] + 0.2 * rng.normal(size=n)])
    for j, share in ((0, 0.2), (1, 0.3), (3, 0.1)):
        x[rng.uniform(size=n) < share, j] = np.nan
    x[7, [0, 1, 3]] = np.nan
    x[9] = np.nan
    return x


def _mice_by_rows(x, rounds):
    """The chain over the rows themselves."""
    miss, means = np.isnan(x), np.nanmean(x, axis=0)
    cur = np.where(miss, means, x)
    order = [j for j in sorted(range(x.shape[1]), key=lambda j: (miss[:, j].sum(), j)) if miss[:, j].any()]
    out = []
    for _ in range(rounds):
        before = cur.copy()
        for j in order:
            rest = [i for i in range(x.shape[1]) if i != j]
            seen = cur[~miss[:, j]]
            mu = seen.mean(0)
            c = seen - mu
            coef = bayesian_ridge(c[:, rest].T @ c[:, rest], c[:, rest].T @ c[:, j], float(c[:, j] @ c[:, j]), float(len(c)))
            out.append((j, coef, mu[j] - coef @ mu[rest]))
            cur[miss[:, j], j] = cur[miss[:, j]][:, rest] @ coef + out[-1][2]
        if np.abs(cur - before).max() < M.TOL * np.nanmax(np.abs(x)):
            break
    return out, cur


@pytest.mark.parametrize("local", [1 << 20, 0])
def test_mice_equals_the_chain_over_rows(spark, monkeypatch, local):
    """Pattern statistics give the rows' own coefficients and stop in the same round; on the driver or as jobs."""
    monkeypatch.setattr(M, "TOL", 1e-2 if local else 1e-1)
    x = _gappy()
    df = _frame(spark, x).repartition(3)
    f = MiceImpute("mice", local_bytes=local, max_rounds=10 if local else 2).fit(df, ["c0", "c1", "c2", "c3"])
    want, cur = _mice_by_rows(x, 10 if local else 2)
    got = [s for r in f.params["rounds"] for s in r]
    assert len(got) == len(want) and len(want) >= 4
    for s, (j, coef, a) in zip(got, want, strict=True):
        assert s["col"] == f"c{j}" and s["coef"] == pytest.approx(coef.tolist(), abs=1e-7) and s["intercept"] == pytest.approx(a, abs=1e-6)
    filled = f.transform(df).orderBy("k").select("c0", "c1", "c2", "c3").collect()
    assert np.allclose([tuple(r) for r in filled], cur, atol=1e-5)


@pytest.mark.parametrize("local", [1 << 20, 0])
def test_em_equals_the_steps_over_rows(spark, local):
    x = _gappy()
    iters = 20 if local else 2
    f = EMImpute("em", local_bytes=local, max_iter=iters).fit(_frame(spark, x).repartition(3), ["c0", "c1", "c2", "c3"])
    mu, sigma = np.nanmean(x, axis=0), np.diag(np.nanvar(x, axis=0))
    for _ in range(iters):
        xhat, extra = M._em_estep(mu, sigma, x)
        new = xhat.mean(0)
        new_sigma = (xhat.T @ xhat + extra) / len(x) - np.outer(new, new)
        done = np.abs(new - mu).max() < M.EM_TOL and np.abs(new_sigma - sigma).max() < M.EM_TOL
        mu, sigma = new, new_sigma
        if done:
            break
    assert np.allclose(f.params["mu"], mu, atol=1e-6) and np.allclose(f.params["sigma"], sigma, rtol=1e-6, atol=1e-6)


def test_pattern_statistics(spark, monkeypatch):
    """Sums by pattern, whatever a task holds; one scan."""
    x = _gappy(13, 90)
    monkeypatch.setattr(patterns, "HELD_PATTERNS", 2)
    p = patterns.Patterns(_frame(spark, x).repartition(4), ["c0", "c1", "c2", "c3"])
    z = x - np.nanmean(x, axis=0)
    want = {}
    for row in z:
        m = tuple(np.isnan(row))
        want.setdefault(m, []).append(np.nan_to_num(row))
    assert len(p.local) == len(want)
    for miss, n, s, c in p.local:
        rows = np.array(want[tuple(miss)])
        assert n == len(rows) and np.allclose(s, rows.sum(0)) and np.allclose(c, rows.T @ rows)


def test_tree_imputes_a_step(spark):
    """The chained tree learns a step of another column; nothing else changes."""
    rng = np.random.default_rng(14)
    a = rng.uniform(size=300)
    x = np.column_stack([a, np.where(a > 0.5, 10.0, -10.0), a * 2])
    x[::6, 1] = np.nan
    df = _frame(spark, x)
    out = {r["k"]: r for r in TreeImpute("dt", max_rounds=2).fit(df, ["c0", "c1", "c2"]).transform(df).collect()}
    assert all(out[i]["c1"] == pytest.approx(10.0 if a[i] > 0.5 else -10.0, abs=4.0) for i in range(0, 300, 6) if abs(a[i] - 0.5) > 0.05)
    assert all(out[i]["c0"] == a[i] and (i % 6 == 0 or out[i]["c1"] == x[i, 1]) for i in range(300))


def test_imputers_without_gaps_or_rows(spark):
    df = _frame(spark, np.arange(6.0).reshape(3, 2), with_nan=False)
    for op in (MiceImpute("mice"), EMImpute("em")):
        assert sorted(map(tuple, op.fit(df, ["c0", "c1"]).transform(df).collect())) == sorted(map(tuple, df.collect()))
        assert op.fit(df.limit(0), ["c0", "c1"]).transform(df.limit(0)).collect() == []


def test_em_conditional_mean(spark):
    rng = np.random.default_rng(9)
    cov = np.array([[1.0, 0.8], [0.8, 1.0]])
    x = rng.multivariate_normal([0, 0], cov, size=2000)
    x[::4, 1] = np.nan
    df = _frame(spark, x)
    f = EMImpute("em").fit(df, ["c0", "c1"])
    assert np.asarray(f.params["sigma"])[0, 1] == pytest.approx(0.8, abs=0.08)
    out = {r["k"]: r["c1"] for r in f.transform(df).collect()}
    mu, s = np.asarray(f.params["mu"]), np.asarray(f.params["sigma"])
    i = 0
    assert out[i] == pytest.approx(mu[1] + s[1, 0] / s[0, 0] * (x[i, 0] - mu[0]))


def test_pca_reconstruction_and_sign(spark):
    rng = np.random.default_rng(10)
    z = rng.normal(size=(200, 2))
    x = np.column_stack([z[:, 0], z[:, 0] + 0.1 * z[:, 1], z[:, 1]])
    df = _frame(spark, x, with_nan=False)
    f = Reduce("pca", k=3).fit(df, ["c0", "c1", "c2"])
    comps = np.asarray(f.params["components"])
    mu = np.asarray(f.params["center"])
    scores = np.array([[r[n] for n in f.names()] for r in f.transform(df).orderBy("k").collect()])
    assert np.allclose(scores @ comps + mu, x, atol=1e-8)
    w, v = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(sorted(f.params["variance"], reverse=True), sorted(w, reverse=True))
    for c in comps:
        assert c[np.argmax(np.abs(c))] > 0


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(100, 4)) + 3.0
    df = _frame(spark, x, with_nan=False)
    f = Reduce("svd", k=2).fit(df, [f"c{j}" for j in range(4)])
    s = np.linalg.svd(x, compute_uv=False)
    assert f.params["singular_values"] == pytest.approx(s[:2].tolist())


def test_gram_weighted(spark):
    from prepforge.functions.linalg import gram
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (3.0, None, 5.0), (2.0, 4.0, 2.0)], "a double, b double, w double")
    n, s, g = gram(df, ["a", "b"], weight="w")
    assert n == 3.0 and s.tolist() == [1 + 4, 2 + 8] and g[0, 1] == 1 * 2 + 2 * 2 * 4
    _ = F


def _mi_by_hand(x, y, keys, name, k=3, seed=0):
    """Ross's estimator over sorted rows, with the operator's noise."""
    import hashlib
    import math

    def digamma(n):
        return -0.5772156649015329 + sum(1.0 / j for j in range(1, int(n)))

    def unit(part, key):
        return (int(hashlib.md5(f"{seed}:{part}:{name}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)

    sd = x.std() or 1.0
    z = np.array([v / sd + 1e-10 * max(1.0, np.abs(x).mean() / sd) * math.sqrt(-2 * math.log(unit(0, i))) * math.cos(2 * math.pi * unit(1, i)) for v, i in zip(x, keys, strict=True)])
    size = {c: int((y == c).sum()) for c in set(y.tolist())}
    on = np.array([size[c] > 1 for c in y.tolist()])
    z, y = z[on], y[on]
    total = digamma(len(z))
    for v, c in zip(z, y.tolist(), strict=True):
        kk = min(k, size[c] - 1)
        r = np.sort(np.abs(z[y == c] - v))[kk]
        near = int((np.abs(z - v) < r - 1e-15).sum())
        total += (digamma(kk) - digamma(size[c]) - digamma(max(near, 1))) / len(z)
    return max(0.0, total)


def test_knn_mutual_information(spark, monkeypatch):
    """Every class, ties, classes of one and two rows, several slices."""
    from prepforge.operators.selection import SelectFeatures, knn_mutual_info
    from prepforge.plans import catalog
    monkeypatch.setattr(catalog, "SLICE_ROWS", 50)
    monkeypatch.setattr(catalog.global_positions, "__defaults__", ("_pos", 50, None))
    rng = np.random.default_rng(31)
    y = rng.integers(0, 3, 200)
    y[0], y[1:3] = 7, 8
    x = np.column_stack([y + 0.3 * rng.normal(size=200), rng.normal(size=200), np.round(rng.normal(size=200)), np.full(200, 2.0)])
    rows = [(i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, d double, y int").repartition(4)
    got = knn_mutual_info(df, ["a", "b", "c", "d"], "y", "k")
    for j, c in enumerate("abcd"):
        assert got[c] == pytest.approx(_mi_by_hand(x[:, j], y, range(200), c), abs=5e-3 if c in "cd" else 1e-6), c
    assert got["a"] > 0.5 > got["b"]
    fitted = SelectFeatures("mutual_info_knn", k=1, key="k").fit(df, ["a", "b"], "y")
    assert fitted.params["keep"] == ["a"]


def test_digamma(spark):
    from prepforge.operators.selection import digamma
    rows = spark.range(1, 40).select("id", digamma(F.col("id")).alias("d")).collect()
    for r in rows:
        assert r["d"] == pytest.approx(-0.5772156649015329 + sum(1.0 / j for j in range(1, r["id"])), abs=1e-12)


def test_tree_chain_writes_whole_rows_once(spark, monkeypatch):
    """A round predicts and stores only the rows with gaps; the others pass through unchanged."""
    rng = np.random.default_rng(31)
    a = rng.normal(size=200)
    x = np.column_stack([a, 3 * a, rng.normal(size=200)])
    x[::10, 1] = np.nan
    df, written, store = _frame(spark, x), [], M.stored
    monkeypatch.setattr(M, "stored", lambda d, name: written.append(d.count()) or store(d, name))
    got = {r["k"]: (r["c0"], r["c1"], r["c2"]) for r in TreeImpute("dt", max_rounds=3).fit(df, ["c0", "c1", "c2"]).transform(df).collect()}
    assert written == [200, 20, 20, 20] * 2 and len(got) == 200
    assert all(got[i] == tuple(x[i]) for i in range(200) if i % 10)
    assert all(abs(got[i][1] - 3 * a[i]) < 1.5 for i in range(0, 200, 10))


def test_knn_imputation_without_gaps_searches_nothing(spark, monkeypatch):
    from prepforge.operators import neighbors

    def search(*args, **kw):
        raise AssertionError("searched")

    monkeypatch.setattr(neighbors, "knn_candidates", search)
    rows = spark.createDataFrame([(1, 1, 2.0, "x"), (2, 3, 4.0, "y"), (3, 5, None, "z")], "k long, a int, b double, s string")
    fitted = KnnImpute("knn", key="k").fit(rows, ["a", "b"])
    out = fitted.transform(rows.where("k < 3"))
    assert out.columns == ["k", "a", "b", "s"] and dict(out.dtypes)["a"] == "double"
    assert sorted(map(tuple, out.collect())) == [(1, 1.0, 2.0, "x"), (2, 3.0, 4.0, "y")]
    with pytest.raises(AssertionError, match="searched"):
        fitted.transform(rows)
