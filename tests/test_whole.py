"""Queries over whole inputs, on small tables, against brute force."""

import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorefabric.functions import diff
from scorefabric.functions import expressions as X
from scorefabric.plans import queries as Q


def save(spark, at, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_turns_are_compared_whole(spark, tmp_path):
    r = np.random.default_rng(5)
    say = lambda n: " ".join(r.choice(["the", "I", "walk", "walked", "Ünter", "so", "um", "in", *map(str, range(60))], n))
    same = say(250)
    rows = [(1, 0, say(300)), (1, 1, say(270)), (2, 0, f"{same} one two"), (2, 1, f"{same} three in the end"), (2, 2, None)]
    d = save(spark, tmp_path, "conversations", rows, "conv_id long, turn int, text string")
    words = {(c, t): re.findall("[a-z0-9']+", (x or "").lower()) for c, t, x in rows}
    pairs = {k: (words[k], words[k[0], k[1] + 1]) for k in words if (k[0], k[1] + 1) in words}
    wer = {(x.conv_id, x.turn): x.wer for x in Q.QUERIES["wer_pairs"](spark, d).collect()}
    assert wer == {k: pytest.approx(edits(a, b) / len(a), abs=1e-6) for k, (a, b) in pairs.items()}
    for name, gone in (("diff_edit_rates", X.FILLERS_EDIT), ("repair_counts", X.FILLERS_REPAIR)):
        got = {(x.conv_id, x.turn): x for x in Q.QUERIES[name](spark, d).collect()}
        assert set(got) == set(pairs)
        for k, (a, b) in pairs.items():
            a, b = ([w for w in ws if w not in gone] for ws in (a, b))
            m = SequenceMatcher(None, a, b, autojunk=False)
            spans = [s for s in m.get_opcodes() if s[0] != "equal"]
            n = max(1, len(a))
            if name == "diff_edit_rates":
                want = (100 * len(spans) / n, m.ratio(), len(b) / n)
                assert (got[k].edits_per100, got[k].ratio, got[k].len_ratio) == pytest.approx(want)
                assert got[k].change_rate == pytest.approx(sum(max(s[2] - s[1], s[4] - s[3]) for s in spans) / n)
            else:
                words = [w for _, i, j, p, q in spans for w in a[i:j] + b[p:q]]
                assert got[k].prep == pytest.approx(100 * sum(w in diff.PREPOSITIONS for w in words) / n)
                assert got[k].art == pytest.approx(100 * words.count("the") / n)
                assert got[k].total == pytest.approx(got[k].art + got[k].aux + got[k].prep + got[k].pron + got[k].morph)


def test_items_beyond_ascii_have_weights_and_neighbours(spark, tmp_path):
    d = save(spark, tmp_path, "benchmark", [(1, "Über die Brücke"), (2, "die brücke über"), (3, "plain words"), (4, None), (6, "plain words café")], "item_id long, text string")
    assert {x.item_id for x in Q.QUERIES["tfidf_weights"](spark, d).collect()} == {1, 2, 3, 6}
    got = {(x.item_id, x.anchor) for x in Q.QUERIES["tfidf_knn_anchors"](spark, d).collect()}
    assert got == {(1, 2), (2, 1), (3, 6), (6, 3)}


def test_stratified_folds_are_of_customers(spark, tmp_path):
    from scorefabric.operators import folds

    r = np.random.default_rng(1)
    rows = [(int(g), str(c)) for g in range(900) for c in r.choice(list("abcd"), r.integers(1, 6), p=[0.6, 0.2, 0.15, 0.05])]
    d = save(spark, tmp_path, "orders", rows, "o_custkey long, o_orderpriority string")
    got = Q.QUERIES["strat_group_folds"](spark, d).toPandas()
    assert sorted(zip(got["o_custkey"], got["repeat"], strict=True)) == [(g, k) for g in range(900) for k in range(3)]
    col = {c: i for i, c in enumerate("abcd")}
    m = np.zeros((900, 4))
    for g, c in rows:
        m[g, col[c]] += 1
    uneven = lambda f: np.std([m[f == k].sum(0) / m.sum(0) for k in range(5)], axis=0).mean()
    for k in range(3):
        mine = got[got["repeat"] == k].sort_values("o_custkey")["fold"].to_numpy()
        assert uneven(mine) < max(2 * uneven(folds.greedy_folds(m, 5, 42 + k)), 0.005)
    hashed = folds.hash_folds(spark.createDataFrame(rows, "g long, s string"), "g").orderBy("g").toPandas()["fold"].to_numpy()
    assert uneven(hashed) > 0.01


def test_linkage_is_of_all_rows_in_rounds_too(spark, tmp_path):
    from scorefabric.operators import similarity

    r = np.random.default_rng(4)
    centre = r.normal(size=(6, 8))
    x = np.vstack([np.repeat(centre, 9, 0) + r.normal(size=(54, 8)) * 0.7, centre[:1], centre[:1], np.zeros((2, 8))])
    d = save(spark, tmp_path, "embeddings", [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want = similarity.average_linkage(x, [0.5, 0.4, 0.3])
    df = spark.read.parquet(f"{d}/embeddings.parquet")
    for got in (Q.QUERIES["linkage_groups"](spark, d), similarity.linked_groups(df, "vec_id", "embedding", [0.5, 0.4, 0.3], most=1, block=16), similarity.linked_groups(df, "vec_id", "embedding", [0.5, 0.4, 0.3], most=25, block=16)):
        rows = got.orderBy("vec_id").toPandas()
        assert all(rows[f"group_{t}"].tolist() == w.tolist() for t, w in zip((50, 40, 30), want, strict=True))
    assert len({i % 4 for i in np.flatnonzero(want[2] == want[2][0])}) > 1


def test_linkage_compares_only_clusters_whose_closest_one_merged(spark, monkeypatch):
    from scorefabric.operators import similarity

    r = np.random.default_rng(11)
    x = np.repeat(r.normal(size=(20, 12)), 6, 0) + r.normal(size=(120, 12)) * 0.8
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    plain, asked = similarity._closest, []

    def counted(asking, clusters, sizes, *rest):
        asked.append(tuple(sizes))
        return plain(asking, clusters, sizes, *rest)

    monkeypatch.setattr(similarity, "_closest", counted)
    rows = similarity.linked_groups(df, "vec_id", "embedding", [0.5, 0.3], most=30, block=64).orderBy("vec_id").toPandas()
    want = similarity.average_linkage(x, [0.5, 0.3])
    assert rows["group_50"].tolist() == want[0].tolist() and rows["group_30"].tolist() == want[1].tolist()
    assert asked[0] == (120, 120) and len(asked) > 2 and all(a < b for a, b in asked[1:])


def test_ridge_beyond_most_rows_equals_the_kernel_form(spark, monkeypatch):
    from scorefabric.operators import folds, models

    r = np.random.default_rng(6)
    x = r.normal(size=(150, 5))
    y = x @ r.normal(size=5) + r.normal(size=150)
    rows = [(k, i, (x[i] * (k == "a") + r.normal(size=5) * 0.3 + 2).tolist(), None if i % 7 == 0 else float(y[i]), i % 12) for k in "ab" for i in range(150)]
    v = spark.createDataFrame(rows, "view string, id long, vec array<double>, y double, g int")
    f = folds.hash_folds(v.where("g < 11"), "g", 3, 2)
    read = lambda: {(q.view, q.id, q.repeat, q.fold): (q.pred, q.alpha) for q in models.ridge_oof(v, f, "id", "vec", "y", "g").collect()}
    want = read()
    monkeypatch.setattr(models, "MOST_ROWS", 100)
    assert read() == {k: pytest.approx(p, rel=1e-6, abs=1e-8) for k, p in want.items()} and len(want) > 300


def test_anchors_come_from_whole_bands_of_other_folds(spark, tmp_path):
    d = save(spark, tmp_path, "embeddings", [(i, i % 9) for i in range(900)], "vec_id long, label int")
    band = {2: 0, 3: 0, 4: 1, 5: 1, 6: 2, 7: 2, 8: 3}  # by label
    got = Q.QUERIES["band_anchors"](spark, d).collect()
    assert sorted((x.vec_id, x.band) for x in got) == [(i, b) for i in range(900) for b in range(4)]
    assert all(band[x.anchor % 9] == x.band and x.anchor % 5 != x.vec_id % 5 for x in got)
    assert all(len({x.anchor for x in got if x.band == b}) > 64 for b in range(4))
