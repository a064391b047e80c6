"""Leaf-wise trees, support vectors, components and the driver, against brute force and dense solvers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorefabric.operators import attribution, boosting, estimators, models
from scorefabric.operators.boosting import Boosting

SMALL = Boosting(trees=6, rate=0.3, leaves=5, least=8, rows=0.7, columns=0.6, penalty=2.0, bins=16, seed=3)


def toy(n=240, d=5, seed=0):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, d)), 1)
    return x, x[:, 0] * 2 + (x[:, 1] > 0.3) * x[:, 2] + r.normal(size=n) * 0.1


def brute_tree(x, g, use, columns, edges, p):
    """Leaves as row masks over all rows; every cut of every leaf is tried on the rows themselves."""
    masks = [np.ones(len(x), bool)]

    def cut(mask):
        m = mask & use
        best = (1e-12, None)
        for j in columns:
            for t in edges[j]:
                left = m & (x[:, j] <= t)
                a, b = left.sum(), m.sum() - left.sum()
                if min(a, b) >= p.least:
                    s = lambda k: (g[k].sum() / boosting.UNIT) ** 2 / (k.sum() + p.penalty)
                    gain = s(left) + s(m & ~left) - s(m)
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (j, t))
        return best

    while len(masks) < p.leaves:
        found = [cut(m) for m in masks]
        k = int(np.argmax([f[0] if f[1] else -1 for f in found]))
        if not found[k][1]:
            break
        j, t = found[k][1]
        m = masks.pop(k)
        masks += [m & (x[:, j] <= t), m & ~(x[:, j] <= t)]
    out = np.zeros(len(x))
    for m in masks:
        out[m] = -p.rate * (g[m & use].sum() / boosting.UNIT) / ((m & use).sum() + p.penalty)
    return out


def test_trees_equal_brute_force():
    x, y = toy()
    h = np.arange(len(y)) * 7919
    edges = boosting.cuts(x, SMALL.bins)
    pred = np.full(len(y), boosting.start_of(y.sum(), len(y)))
    for k in range(SMALL.trees):
        pred += brute_tree(x, np.rint((pred - y) * boosting.UNIT), boosting.drawn_rows(h, SMALL, k), boosting.drawn_columns(x.shape[1], SMALL, k), edges, SMALL)
    fit = boosting.grown(x, y, h, SMALL)
    assert np.allclose(fit.predict(x), pred, atol=1e-9)
    assert np.std(y - pred) < 0.6 * np.std(y)


def covers(node, least):
    return [node["cover"]] if "value" in node else covers(node["left"], least) + covers(node["right"], least)


def test_trees_have_their_leaves():
    x, y = toy(600)
    fit = boosting.grown(x, y, np.arange(len(y)), Boosting(trees=4))
    for t in fit.trees:
        assert len(covers(t, 25)) <= 7 and min(covers(t, 25)) >= 25
    assert max(len(covers(t, 25)) for t in fit.trees) == 7
    paths = [leaf for t in fit.trees for leaf in attribution.leaves(t)]
    assert np.allclose(attribution.shapley(x[:20], paths).sum(1) + attribution.expected(paths), fit.predict(x[:20]) - fit.start)


def test_rows_and_columns_are_drawn():
    h = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 20_000)
    a, b = (boosting.drawn_rows(h, Boosting(), k) for k in (0, 1))
    assert abs(a.mean() - 0.8) < 0.01 and abs((a & b).mean() - 0.64) < 0.01
    assert len(boosting.drawn_columns(9, Boosting(), 0)) == 5 and len(boosting.drawn_columns(1, Boosting(), 0)) == 1


@pytest.mark.parametrize("rewrite", [2, 50])
def test_trees_by_aggregates_equal_trees_in_a_task(spark, rewrite, monkeypatch, tmp_path):
    monkeypatch.setattr(boosting, "REWRITE", rewrite)
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    x, y = toy(150)
    own = np.arange(len(y)) % 3
    rows = [(i, [None if (i, j) == (3, 1) else float(v) for j, v in enumerate(x[i])], None if i in (5, 6) else float(y[i]), [int(own[i]), 9]) for i in range(len(y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double, own array<int>")
    h = np.array([r.h for r in df.select("id", F.xxhash64("id").alias("h")).orderBy("id").collect()])
    x[3, 1] = np.nan
    known = ~np.isin(np.arange(len(y)), (5, 6))
    edges = boosting.cuts(x[known], SMALL.bins)
    fits = [(SMALL, 0, 1), (SMALL, 1, 0), (SMALL, 0, -1)]
    got = boosting.fitted(df, "id", "x", "y", fits, "own", edges)
    for (p, repeat, fold), fit in zip(fits, got, strict=True):
        use = known & ((own != fold) | (repeat == 1) | (fold < 0))
        want = boosting.grown(x[use], y[use], h[use], p, edges)
        assert fit.start == want.start and fit.trees == want.trees
    back = {r.id: r.pred for r in boosting.predicted(df, "x", got).collect()}
    assert np.allclose([back[i] for i in range(len(y))], np.mean([f.predict(x) for f in got], 0))


def test_fits_in_tasks_read_the_binned_rows_once(spark, monkeypatch, tmp_path):
    """Trees of a task a fit are those of aggregates, without any aggregate; missing folds, repeats and labels included."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    x, y = toy(150)
    rows = [(i, [None if (i, j) == (3, 1) else float(v) for j, v in enumerate(x[i])], None if i in (5, 6) else float(y[i]), [[i % 3, 9], [None, 0], [i % 3], []][i % 4]) for i in range(len(y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, y double, own array<int>").repartition(3)
    edges = boosting.cuts(x, SMALL.bins)
    fits = [(SMALL, 0, 1), (SMALL, 1, 0), (SMALL, 0, -1)]
    want = boosting.fitted(df, "id", "x", "y", fits, "own", edges)
    monkeypatch.setattr(boosting, "AT_ONCE", 40)
    monkeypatch.setattr(boosting, "FEW", 30)
    monkeypatch.setattr(boosting, "_summed", lambda *a: pytest.fail("an aggregate for each depth of each tree"))
    got = boosting.fitted(df, "id", "x", "y", fits, "own", edges, held=150 * len(edges))
    assert [(f.start, f.trees) for f in got] == [(f.start, f.trees) for f in want]


def test_cuts_of_a_table(spark):
    x, _ = toy(400)
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "x array<double>")
    for a, b in zip(boosting.cuts_of(df, "x"), boosting.cuts(x), strict=True):
        assert np.allclose(a, b)


# ---- support vectors ----


def dual(k, y, w, eps):
    return w @ k @ w / 2 - y @ w + eps * np.abs(w).sum()


@pytest.mark.parametrize("c,eps", [(3.0, 0.1), (0.2, 0.3), (50.0, 0.01)])
def test_support_vectors_against_a_dense_solver(c, eps):
    x, y = toy(60, 3, 2)
    k = models.rbf(x, x, 0.4)
    w, bias, gap = models.svr_fit(k, y, c, eps, tol=1e-8)
    assert gap <= 1e-8 and abs(w.sum()) < 1e-9 and np.abs(w).max() <= c + 1e-12
    # projected gradient on (up, down) parts, projected onto the sum constraint by bisection
    n, z = len(y), np.zeros(2 * len(y))
    step = 1 / (2 * np.linalg.eigvalsh(k)[-1])
    s = np.r_[np.ones(n), -np.ones(n)]
    for _ in range(20_000):
        f = k @ (z[:n] - z[n:])
        a = z - step * np.r_[f - y + eps, y - f + eps]
        low, high = -1e3, 1e3
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if (s * np.clip(a - mid * s, 0, c)).sum() > 0 else (low, mid)
        z = np.clip(a - low * s, 0, c)
    other = z[:n] - z[n:]
    assert dual(k, y, w, eps) <= dual(k, y, other, eps) + 1e-6
    assert np.isclose(dual(k, y, w, eps), dual(k, y, other, eps), rtol=1e-2, atol=1e-3)
    # no gap to the primal objective: optimal, whatever the other solver reaches
    primal = w @ k @ w / 2 + c * np.maximum(np.abs(y - k @ w - bias) - eps, 0).sum()
    assert np.isclose(primal, -dual(k, y, w, eps), rtol=1e-5, atol=1e-5)
    free = (np.abs(w) > 1e-6) & (np.abs(w) < c - 1e-6)
    assert np.allclose((y - k @ w - bias)[free], eps * np.sign(w[free]), atol=1e-6)
    outside = np.abs(y - k @ w - bias) > eps + 1e-6
    assert np.allclose(np.abs(w[outside]), c)


def test_support_vectors_of_little():
    assert models.svr(np.zeros((0, 0)), np.zeros((2, 0)), np.zeros(0)).tolist() == [0, 0]
    assert np.allclose(models.svr(np.ones((3, 3)), np.ones((1, 3)), np.full(3, 2.5)), 2.5)


def test_components_of_a_table(spark):
    x, _ = toy(300, 6, 4)
    x[:, 5] = 7.0
    df = spark.createDataFrame([([float(v) for v in r],) for r in x] + [(None,)], "x array<double>").repartition(5)
    mean, scale, axes, variance = models.principal(df, "x", 4)
    z = (x - x.mean(0)) / np.where(x.std(0) > 1e-8, x.std(0), 1)
    u, s, v = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(variance, (s**2 / len(x))[:4]) and np.allclose(np.abs(axes), np.abs(v[:4].T), atol=1e-6)
    assert np.allclose(((x - mean) / scale @ axes).var(0), variance)
    assert all(len(a) == 0 for a in models.principal(df.limit(0), "x"))


# ---- the driver ----


def view_of(spark, n=120, seed=5):
    x, y = toy(n, 4, seed)
    rows = [(v, i, [float(e) for e in x[i] * (1 if v == "a" else 2)], None if i % 6 == 0 else float(y[i]), i % 11) for i in range(n) for v in ("a", "b")]
    view = spark.createDataFrame([*rows, ("a", 9999, None, 1.0, 3)], "view string, id long, vec array<double>, y double, g int")
    folds = spark.createDataFrame([(g, r, (g + r * (g // 3)) % 3) for g in range(11) for r in (0, 1)], "g int, repeat int, fold int")
    return view, folds, x, y


KINDS = [estimators.Ridge(), estimators.Ridge("loo"), estimators.Support(components=3), estimators.Trees(SMALL, (0, 1))]


@pytest.mark.parametrize("estimator", KINDS, ids=lambda e: type(e).__name__)
def test_one_driver_for_all(spark, estimator):
    view, folds, x, y = view_of(spark)
    got = estimators.predictions(view, folds, "id", "vec", "y", "g", estimator).toPandas()
    p = {(r.view, r.repeat, r.fold, r.id): r.pred for r in got.itertuples()}
    h = {r.id: r.h for r in view.select("id", F.xxhash64("id").alias("h")).distinct().collect()}
    ids, known = np.arange(len(y)), np.arange(len(y)) % 6 != 0
    for v, by in (("a", 1), ("b", 2)):
        for r in (0, 1):
            own = np.array([(g + r * (g // 3)) % 3 for g in ids % 11])
            for f in range(3):
                train, new = ids[known & (own != f)], ids[~known | (own == f)]
                want, _ = estimator.fit_predict(x[train] * by, y[train], train % 11, np.array([h[i] for i in train]), x[new] * by, x * by)
                assert np.allclose([p[v, r, f, i] for i in new], want, atol=1e-6)
        want, _ = estimator.fit_predict(x[known] * by, y[known], ids[known] % 11, np.array([h[i] for i in ids[known]]), x * by, x * by)
        assert np.allclose([p[v, -1, -1, i] for i in ids], want, atol=1e-6)
    assert len(p) == 2 * (2 * (known.sum() + 3 * (~known).sum()) + len(y))


@pytest.mark.parametrize("estimator", [estimators.Ridge(), estimators.Trees(SMALL, (0, 1))], ids=lambda e: type(e).__name__)
def test_large_views_have_equal_results(spark, estimator, monkeypatch, tmp_path):
    from dataclasses import replace

    spark.sparkContext.setCheckpointDir(str(tmp_path))
    view, folds, x, y = view_of(spark, 90)
    if isinstance(estimator, estimators.Trees):  # edges of all labelled rows in both forms
        edges = {v: boosting.cuts(x[np.arange(90) % 6 != 0] * by, SMALL.bins) for v, by in (("a", 1), ("b", 2))}
        plain = boosting.grown
        monkeypatch.setattr(boosting, "cuts_of", lambda df, *_: edges[df.first()["view"]])
        small = None
    else:
        small = estimators.predictions(view, folds, "id", "vec", "y", "g", estimator).toPandas()
    large = estimators.predictions(view, folds, "id", "vec", "y", "g", replace(estimator, most_rows=10)).toPandas()
    assert len(large) == 2 * (2 * (75 + 3 * 15) + 90)
    if small is not None:
        at = ["view", "repeat", "fold", "id"]
        both = small.merge(large, on=at, how="outer")
        assert len(both) == len(small) and np.allclose(both.pred_x, both.pred_y, atol=1e-6)
        return
    h = {r.id: r.h for r in view.select("id", F.xxhash64("id").alias("h")).distinct().collect()}
    p = {(r.view, r.repeat, r.fold, r.id): r.pred for r in large.itertuples()}
    ids, known = np.arange(90), np.arange(90) % 6 != 0
    for v, by in (("a", 1), ("b", 2)):
        train = ids[known]
        fits = [plain(x[train] * by, y[train], np.array([h[i] for i in train]), replace(SMALL, seed=s), edges[v]) for s in (0, 1)]
        assert np.allclose([p[v, -1, -1, i] for i in ids], np.mean([f.predict(x * by) for f in fits], 0))


def test_support_vectors_say_what_they_take(spark):
    view, folds, *_ = view_of(spark, 30)
    with pytest.raises(ValueError, match="takes 10"):
        estimators.predictions(view, folds, "id", "vec", "y", "g", estimators.Support(most_rows=10))


def test_support_vectors_of_large_views_equal_those_of_one_kernel(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    view, folds, *_ = view_of(spark, 90)
    one = estimators.predictions(view, folds, "id", "vec", "y", "g", estimators.Support(components=3, tol=1e-6)).toPandas()
    rounds = estimators.predictions(view, folds, "id", "vec", "y", "g", estimators.Support(components=3, tol=1e-6, most_rows=10, working=48)).toPandas()
    both = one.merge(rounds, on=["view", "repeat", "fold", "id"], how="outer")
    assert len(both) == len(one) == len(rounds) == 2 * (2 * (75 + 3 * 15) + 90)
    assert np.allclose(both.pred_x, both.pred_y, atol=1e-5) and both.figure_y.max() <= 1e-6


def test_driver_of_nothing(spark):
    view, folds, *_ = view_of(spark, 30)
    assert estimators.predictions(view.limit(0), folds, "id", "vec", "y", "g", estimators.Ridge()).collect() == []


def test_support_vectors_of_a_large_view_are_fitted_in_a_task_each(spark, monkeypatch):
    """Beyond one kernel a fit takes working sets in its own task, and rounds over all tasks only where a task can't hold the rows."""
    r = np.random.default_rng(11)
    x = r.normal(size=(160, 5))
    y = np.sin(x[:, 0]) + 0.3 * r.normal(size=160)
    rows = [(i, [float(e) for e in x[i]], float(y[i]) if i % 7 else None, i % 20) for i in range(160)]
    view = spark.createDataFrame(rows, "id long, vec array<double>, y double, g long").selectExpr("'a' view", "*").unionByName(spark.createDataFrame(rows[:150], "id long, vec array<double>, y double, g long").selectExpr("'b' view", "*"))
    folds = spark.createDataFrame([(g, 0, g % 4) for g in range(20)], "g long, repeat int, fold int")
    of = lambda **k: estimators.predictions(view, folds, "id", "vec", "y", "g", estimators.Support(tol=1e-6, **k)).toPandas().sort_values(["view", "repeat", "fold", "id"]).reset_index(drop=True)
    want, rounds = of(), of(most_rows=10, working=640, held=0)
    monkeypatch.setattr(estimators, "_large_support", None)
    held = of(most_rows=10, working=32)
    single = estimators.predictions(view, folds, "id", "vec", "y", "g", estimators.Support(most_rows=10, working=32)).toPandas().sort_values(["view", "repeat", "fold", "id"])
    for got, near in ((rounds, 1e-4), (held, 1e-4), (single, 1e-2)):
        assert got[["view", "id", "repeat", "fold"]].to_numpy().tolist() == want[["view", "id", "repeat", "fold"]].to_numpy().tolist()
        assert np.abs(got["pred"].to_numpy() - want["pred"].to_numpy()).max() < near
    assert held["figure"].max() <= 1e-6 and single["figure"].max() <= 1e-3
