"""Exact quantiles and the bootstrap of a fixed number of draws, against numpy."""

import importlib
import math
import pkgutil

import numpy as np
import pytest

import scorefabric
from scorefabric.operators import contracts, quantiles, resampling, stats

PROBS = [0.0, 0.25, 0.5, 0.9, 0.975, 1.0]


def values(seed, n):
    r = np.random.default_rng(seed)
    return np.concatenate([r.normal(size=n), np.full(n // 2, 0.25), np.round(r.exponential(size=n) * 1e6), -(10.0 ** r.uniform(-300, 300, n // 5))])


@pytest.mark.parametrize("grid,most", [(1000, 1 << 20), (50, 60), (20, 5)])
def test_quantiles_are_exact(spark, grid, most, monkeypatch):
    monkeypatch.setattr(quantiles, "GRID", grid)
    monkeypatch.setattr(quantiles, "_width", lambda n: 5 * n / grid + 5)
    x = values(0, 3000)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(7)
    (got,) = quantiles.quantiles(df, "x", PROBS, most=most).collect()
    assert got.n == len(x) and np.allclose(got.q, np.quantile(x, PROBS), rtol=1e-12, atol=0)


def test_quantiles_by_group(spark):
    r = np.random.default_rng(1)
    rows = [(None if g == 3 else f"g{g}", g % 2, float(v)) for g in range(6) for v in np.round(r.normal(size=[1, 2, 3, 40, 900, 5000][g]), 2)]
    df = spark.createDataFrame([*rows, ("none", 0, None)], "g string, h int, x double")
    got = {(q.g, q.h): (q.n, q.q) for q in quantiles.quantiles(df, "x", PROBS, ["g", "h"]).collect()}
    assert len(got) == 6
    for (g, h), (n, q) in got.items():
        mine = [v for a, b, v in rows if (a, b) == (g, h)]
        assert n == len(mine) and np.allclose(q, np.quantile(mine, PROBS), rtol=1e-12, atol=1e-15)
    d = {(q.g, q.h): q for q in stats.describe(df, "x", ["g", "h"]).collect()}
    assert d["none", 0].n == 0 and d["none", 0].q50 is None and len(d) == 7
    assert d[None, 1].q50 == got[None, 1][1][2]


def test_quantiles_of_odd_values(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (float("-inf"),), (2.0,)], "x double")
    q = quantiles.quantiles(df, "x", [0.0, 1 / 3, 1.0]).first().q
    assert q[0] == -math.inf and q[1] == 1.0 and math.isnan(q[2])
    assert quantiles.quantiles(df.limit(0), "x", PROBS).collect() == []
    one = stats.describe(df.limit(0), "x").first()
    assert one.n == 0 and one.q50 is None
    assert stats.quantile_buckets(spark.createDataFrame([(None,), (1.0,), (2.0,)], "x double"), "x", "b").select("b").collect().count((None,)) == 1
    filled = contracts.fill_medians(spark.createDataFrame([(None, None), (1.0, None), (4.0, None)], "x double, y double"), ["x", "y"])
    assert sorted(filled.collect(), key=str) == [(1.0, None), (2.5, None), (4.0, None)]


# ---- bootstrap ----


def test_shares_add_up():
    sizes = [5, 0, 17, 4, 9, 1, 30]
    parts = np.array([resampling.shares(sizes, b, 4000, 3) for b in range(len(sizes))])
    assert (parts.sum(0) == sum(sizes)).all() and (parts[1] == 0).all()
    assert np.allclose(parts.mean(1), sizes, atol=0.3)
    p = np.array(sizes) / sum(sizes)
    assert np.allclose(parts.var(1), sum(sizes) * p * (1 - p), rtol=0.12, atol=0.02)


@pytest.mark.parametrize("cells", [1 << 22, 100])
def test_multiplicities(cells, monkeypatch):
    monkeypatch.setattr(resampling, "CELLS", cells)
    sizes = [12, 30, 8]
    w = np.concatenate([np.concatenate([m for _, m in resampling.multiplicities(sizes, b, 3000, 0)]) for b in range(3)], axis=1)
    assert w.shape == (3000, 50) and (w.sum(1) == 50).all()
    assert np.allclose(w.mean(0), 1, atol=0.12) and np.allclose(w.var(0), 0.98, atol=0.2)


def test_bootstrap_against_drawn_rows(spark):
    r = np.random.default_rng(2)
    rows = [(int(g), float(y := r.normal()), float(y + r.normal() * 0.3), float(y + r.normal() * 0.5)) for g in r.integers(0, 40, 300)]
    df = spark.createDataFrame([*rows, (1, None, 0.0, 0.0), (2, 1.0, float("nan"), 1.0)], "g int, y double, p double, q double").repartition(3)
    got = {(x.draw, x.model): x for x in resampling.bootstrap(df, "g", "y", ["p", "q"], 50, seed=5, block=16).collect()}
    assert len(got) == 100
    groups = sorted({g for g, *_ in rows})
    placed, sizes = resampling.dealt(spark.createDataFrame([(g,) for g in groups], "g int"), "g", 16)
    block = {x.g: x._block for x in placed.collect()}
    of = {b: [g for g in groups if block[g] == b] for b in range(len(sizes))}
    times = {g: [] for g in groups}
    for b, mine in of.items():
        w = np.concatenate([m for _, m in resampling.multiplicities(sizes, b, 50, 5)]) if mine else None
        for k, g in enumerate(mine):
            times[g] = w[:, k]
    assert len(sizes) > 1 and (sum(times.values()) == len(groups)).all()
    for draw in range(50):
        some = np.array([x[1:] for x in rows for _ in range(times[x[0]][draw])])
        for k, m in ((1, "p"), (2, "q")):
            x = got[draw, m]
            assert x.n == len(some) and np.isclose(x.rmse, np.sqrt(np.mean((some[:, k] - some[:, 0]) ** 2))) and np.isclose(x.r, np.corrcoef(some[:, 0], some[:, k])[0, 1])


def test_bootstrap_of_nothing(spark):
    assert resampling.bootstrap(spark.createDataFrame([], "g int, y double, p double"), "g", "y", ["p"], 5).collect() == []


@pytest.mark.parametrize(("name", "draws"), [("bootstrap_ci", 1000), ("bootstrap_paired", 2000)])
def test_bootstrap_queries(spark, name, draws):
    """The queries' summaries equal numpy's over the draws of the operator itself, all of them."""
    from scorefabric.plans import queries

    at = "/root/testdata/sf0.001"
    drawn = resampling.bootstrap(queries._by_supplier(spark, at), "g", "y", ["a", "b"], draws).toPandas()
    assert sorted(drawn.draw) == sorted([*range(draws)] * 2)
    got = queries.QUERIES[name](spark, at).collect()
    if name == "bootstrap_ci":
        for x in got:
            e = drawn[drawn.model == x.model]
            assert np.isclose(x.se_rmse, e.rmse.std(ddof=0)) and np.isclose(x.rmse_low, e.rmse.quantile(0.025)) and np.isclose(x.se_composite, e.composite.std(ddof=0))
    else:
        a, b = (drawn[drawn.model == m].sort_values("draw").rmse.to_numpy() for m in "ab")
        assert np.isclose(got[0].p_better_rmse, (b < a).mean()) and np.allclose(got[0].rmse_ci, np.quantile(b - a, [0.025, 0.975]))


def test_all_names_exist():
    for m in pkgutil.walk_packages(scorefabric.__path__, "scorefabric."):
        if ".llm" not in m.name:
            module = importlib.import_module(m.name)
            assert all(hasattr(module, name) for name in getattr(module, "__all__", []))
