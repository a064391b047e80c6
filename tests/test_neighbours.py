"""Cosine joins, nearest vectors and nearest texts against brute force, and what their bounds leave out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorefabric.operators import similarity as S


def vectors(seed, n=300, d=6, centres=12, spread=0.15):
    r = np.random.default_rng(seed)
    x = r.normal(size=(centres, d))[r.integers(0, centres, n)] + r.normal(size=(n, d)) * spread
    x[5] = 0
    x[9] = 0
    x[40:80] = x[40]
    x[100] = -x[40] * 3
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(x)], "id long, v array<double>")


def cosines(x, y):
    u = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    return u(x) @ u(y).T


@pytest.mark.parametrize("seed,block,threshold", [(0, 16, 0.9), (1, 8, 0.5), (2, 1000, 0.7), (3, 5, 0.0), (4, 16, 0.999)])
def test_cosine_pairs(spark, seed, block, threshold):
    x = vectors(seed)
    s = cosines(x, x)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if s[i, j] > threshold + 1e-9}
    maybe = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if abs(s[i, j] - threshold) <= 1e-9}
    rows = S.cosine_pairs(frame(spark, x), "id", "v", threshold, block).collect()
    got = {(r.a, r.b) for r in rows}
    assert len(rows) == len(got) and want <= got <= want | maybe
    assert all(np.isclose(r.sim, s[r.a, r.b]) for r in rows)


def test_blocks_that_cannot_match_are_not_paired(spark):
    """Twice the clusters, twice the rows: pairs of blocks double and do not grow four times."""
    sizes = []
    for centres in (20, 40):
        x = np.repeat(np.random.default_rng(7).normal(size=(centres, 8)), 40, axis=0)
        x += np.random.default_rng(8).normal(size=x.shape) * 0.02
        dealt, pairs = S.block_pairs(frame(spark, x), "id", "v", 0.95, 20)
        blocks = dealt.select("blk").distinct().count()
        sizes.append((blocks, pairs.count()))
    (b1, p1), (b2, p2) = sizes
    assert p2 < 0.5 * b2 * (b2 + 1) / 2 and p2 < 3 * p1
    assert dealt.groupBy("blk").count().agg(F.max("count")).first()[0] <= 60


def test_a_vector_is_sent_to_groups_not_to_blocks(spark):
    """Rows shuffled for a pairing of 20 blocks: once for each of the groups that meet, GROUPS + 1 at most."""
    x = np.random.default_rng(3).normal(size=(400, 16))
    plan = S._of_groups
    sent = []

    def counted(*a):
        out = plan(*a)
        sent.append(out.count().agg(F.sum("count")).first()[0])
        return out

    S._of_groups = counted
    try:
        pairs = {(r.a, r.b) for r in S.cosine_pairs(frame(spark, x), "id", "v", 0.2, 20).collect()}
        links = [(r.a, r.b) for r in S.cosine_links(frame(spark, x), "id", "v", 0.6, 20).collect()]
    finally:
        S._of_groups = plan
    s = cosines(x, x)
    assert pairs == {(i, j) for i in range(400) for j in range(i + 1, 400) if s[i, j] > 0.2}
    assert len(sent) == 2 and max(sent) <= (S.GROUPS + 1) * 400
    up = list(range(400))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    want = [(i, j) for i in range(400) for j in range(i + 1, 400) if s[i, j] > 0.6]
    parts = []
    for some in (want, links):
        up[:] = range(400)
        for i, j in some:
            a, b = sorted((find(i), find(j)))
            up[b] = a
        parts.append([find(i) for i in range(400)])
    assert want and parts[0] == parts[1]


@pytest.mark.parametrize("seed,block,k", [(0, 16, 1), (1, 8, 3), (2, 1000, 2), (3, 5, 4)])
def test_nearest(spark, seed, block, k):
    x, y = vectors(seed), vectors(seed + 50, 120)
    y[:60] = x[:60]
    s = cosines(y, x)
    s[np.arange(120), np.arange(120)] = -np.inf  # a key is left out of its own search
    got = {}
    for r in S.nearest(frame(spark, y), frame(spark, x), "id", "v", k, block).collect():
        got.setdefault(r.id, []).append((r.neighbour, r.sim))
    assert sorted(got) == list(range(120))
    for i, found in got.items():
        best = np.sort(s[i])[::-1][:k]
        assert len({n for n, _ in found}) == k and np.allclose(sorted((v for _, v in found), reverse=True), best)
        assert all(np.isclose(s[i, n], v) for n, v in found)
    assert [n for n, _ in sorted(got[5])] == list(range(k))  # a zero vector: all are alike, the least keys win


def test_a_search_sends_vectors_to_groups(spark, monkeypatch):
    """Vectors that no bound keeps apart: a row is shuffled once for each group of the other side, GROUPS / 2 at most."""
    x = np.random.default_rng(5).normal(size=(600, 24))
    plan, sent = S._of_groups, []

    def counted(*a):
        out = plan(*a)
        sent.append(out.count().agg(F.sum("count")).first()[0])
        return out

    monkeypatch.setattr(S, "_of_groups", counted)
    got = {r.id: r.neighbour for r in S.nearest(frame(spark, x[:200]), frame(spark, x), "id", "v", 1, 20).collect()}
    s = cosines(x[:200], x)
    s[np.arange(200), np.arange(200)] = -np.inf
    assert got == dict(enumerate(s.argmax(1).tolist())) and sent[0] <= 800 * S.GROUPS // 2


def test_a_search_sends_a_vector_once(spark, monkeypatch):
    """However many strips of the other side a row meets, it is shuffled once, into its own."""
    x = np.random.default_rng(5).normal(size=(600, 24))
    x[300:340] = x[3]  # copies beyond a block
    plan, sent = S._of_groups, []

    def counted(*a):
        out = plan(*a)
        sent.append(out.count().agg(F.sum("count")).first()[0])
        return out

    monkeypatch.setattr(S, "_of_groups", counted)
    got = {}
    for r in S.nearest(frame(spark, x[:200]), frame(spark, x), "id", "v", 3, 20).collect():
        got.setdefault(r.id, []).append(r.sim)
    s = cosines(x[:200], x)
    s[np.arange(200), np.arange(200)] = -np.inf
    assert all(np.allclose(sorted(got[i]), np.sort(s[i])[-3:]) for i in range(200)) and sum(sent) <= 800


def test_nearest_of_nothing(spark):
    x = frame(spark, vectors(0, 110))
    assert S.nearest(x.limit(0), x, "id", "v").collect() == S.nearest(x, x.limit(0), "id", "v").collect() == []
    assert S.cosine_pairs(x.limit(0), "id", "v", 0.5).collect() == []
    assert S.nn_threshold(x.limit(0), x, "id", "v") is None
    with pytest.raises(ValueError):
        S.cosine_pairs(x, "id", "v", -0.1)


def brute_texts(docs, folds, k, digits):
    from collections import Counter
    from math import log, sqrt

    grams = lambda t: [*(w := t.split()), *map(" ".join, zip(w, w[1:]))]
    tf = {i: Counter(grams(t)) for i, t in docs}
    df = Counter(g for c in tf.values() for g in c)
    raw = {i: {g: (1 + log(n)) * (log((1 + len(docs)) / (1 + df[g])) + 1) for g, n in c.items() if df[g] >= 2} for i, c in tf.items()}
    unit = {i: {g: v / sqrt(sum(e * e for e in c.values())) for g, v in c.items()} for i, c in raw.items()}
    out = {}
    for q in unit:
        sims = [(-(round(sum(v * unit[a].get(g, 0) for g, v in unit[q].items()), digits)), a) for a in unit if a != q and folds[a] >= 0 and (folds[q] < 0 or folds[q] != folds[a]) and unit[q].keys() & unit[a].keys()]
        out[q] = [(a, -s) for s, a in sorted(sims)[:k]]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("rare", [0, 3, 64])
@pytest.mark.parametrize("seed", [0, 1])
def test_nearest_texts(spark, rare, seed):
    r = np.random.default_rng(seed)
    words = ["the", "of", *[f"w{i:02d}" for i in range(40)]]
    p = np.r_[0.25, 0.15, np.full(40, 0.015)]
    docs = [(i, " ".join(r.choice(words, int(r.integers(1, 25)), p=p))) for i in range(80)] + [(90, ""), (91, "alone"), (92, "the the"), (93, "the the")]
    folds = {i: int(r.integers(-1, 4)) for i, _ in docs}
    df = spark.createDataFrame(docs, "id long, text string")
    pool = spark.createDataFrame(list(folds.items()), "id long, fold int")
    got = {}
    for x in S.text_neighbours(S.tfidf(df, "id", "text"), pool, "id", 4, digits=6, rare=rare).collect():
        got.setdefault(x.id, []).append((x.anchor, x.sim))
    want = brute_texts(docs, folds, 4, 6)
    assert sorted(got) == sorted(want)
    for q, found in want.items():
        assert sorted(n for n, _ in got[q]) == sorted(n for n, _ in found) and np.allclose(sorted(v for _, v in got[q]), sorted(v for _, v in found), atol=2e-6)


def test_frequent_terms_make_few_candidates(spark):
    """Every text holds one frequent term and has near twins by rare terms: the frequent one makes no pairs of all texts."""
    docs = [(i, f"a{i // 6} b{i // 6} c{i // 6} d{i // 6} frequent") for i in range(240)]
    df = spark.createDataFrame(docs, "id long, text string").selectExpr("id", "text")
    weights = S.tfidf(df, "id", "text")
    pool = df.selectExpr("id", "cast(0 as int) as fold").withColumn("fold", (F.col("id") % 2).cast("int"))
    made = []
    real = S.checkpointed

    def seen(table):
        out = real(table)
        made.append((table.columns, out.count()))
        return out

    S.checkpointed = seen
    try:
        got = S.text_neighbours(weights, pool, "id", 2).count()
    finally:
        S.checkpointed = real
    alive = [n for columns, n in made if columns == ["q", "anchor", "s"]]
    assert got == 480 and alive[0] <= 240 * 3


def test_components_of_a_long_chain_keep_plan_statistics_small(spark):
    """Every round joins what the last one made: its estimated size must not be the product of all earlier ones'."""
    n = 2000
    nodes, edges = spark.range(n).withColumnRenamed("id", "n"), spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = S.components(edges, nodes, "n")
    assert int(got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 40
    assert got.count() == n and got.select("component").distinct().collect()[0][0] == 0
