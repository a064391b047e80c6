"""Hand cases and properties of operators."""

import io
import json
import wave

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorefabric.functions import diff, syntax
from scorefabric.functions import expressions as X
from scorefabric.operators import attribution, contracts, folds, models, sequences, similarity, stats
from scorefabric.plans.stages import Stages
from scorefabric.sources import readers, sinks


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def words(s):
    return F.split(F.lit(s), " ") if s else F.array().cast("array<string>")


@pytest.mark.parametrize(("ref", "hyp", "want"), [("", "a", 1.0), ("", "", 0.0), ("a b c d", "a x c d e", 0.5)])
def test_wer(spark, ref, hyp, want):
    assert one(spark, X.wer(words(ref), words(hyp))) == want


def test_bins_gate_flag_stratum(spark):
    assert [one(spark, X.duration_bin(F.lit(v))) for v in (44.0, 44.01, 46.0, 59.0, 59.01, -1.0)] == ["<44", "44-46", "44-46", "46-59", ">=59", "nan"]
    assert [one(spark, X.noise_gate(F.lit(a), F.lit(b))) for a, b in ((4.99, 0.91), (5.0, 0.95), (3.0, 0.9))] == [True, False, False]
    assert [one(spark, X.near_45(F.lit(45.06 + d))) for d in (0.19, -0.19, 0.21, -0.21)] == [1, 1, 0, 0]
    assert [one(spark, X.stratum(F.lit(g))) for g in (1.0, 1.5, 2.0, 2.5, 5.0)] == [4, 4, 4, 5, 10]


def test_clip_keeps_null_and_nan(spark):
    assert one(spark, X.clip(F.lit(None).cast("double"), 1, 5)) is None
    assert np.isnan(one(spark, X.clip(F.lit(float("nan")), 1, 5)))
    assert [one(spark, X.clip(F.lit(v), 1, 5)) for v in (0.0, 3.0, 9.0)] == [1.0, 3.0, 5.0]


def test_score_distribution(spark):
    s = X.score_distribution(F.array(*[F.lit(float(k == 8)) for k in range(9)]))
    assert [one(spark, s[k]) for k in ("exp", "sd", "p_le2", "p_ge45", "argmax")] == [5.0, 0.0, 0.0, 1.0, 5.0]


def test_surprisal_of_nothing(spark):
    s = X.surprisal(F.array().cast("array<double>"))
    assert [one(spark, c) for c in s.values()] == [0.0, 0.0, 0.0, 0.0, 1.0, 0.0]


def test_mattr_valid_tokens_and_text(spark):
    assert one(spark, X.mattr(words("a b a"))) == pytest.approx(2 / 3)
    assert sum(one(spark, X.valid_tokens(F.lit(45.0), 750))) == 375 + 188
    assert one(spark, X.strip_closing(F.lit("so. Thanks for watching!"))) == "so. "
    assert one(spark, X.normal_token(F.lit(" “É! "))) == "é"
    assert one(spark, X.truncate_words(F.lit("a b c"), 2)) == "a b ..."


def test_timing(spark):
    w = F.expr("array(named_struct('start',0.5D,'end',1.0D,'word','So','prob',0.9D), named_struct('start',1.1D,'end',1.5D,'word','um,','prob',0.4D), named_struct('start',1.8D,'end',2.0D,'word','so','prob',0.8D), named_struct('start',2.1D,'end',2.5D,'word','so.','prob',0.7D))")
    got = X.unpacked(spark.range(1), [], X.timing_features(w, F.lit(60.0))).first().asDict()
    assert got["n_words"] == 4 and got["wpm"] == 4 and got["lead_time"] == 0.5
    assert got["mean_run_len"] == 2 and got["max_run_len"] == 2 and got["pause25_per_min"] == 1
    assert got["filler_per100"] == 25 and got["repeat_per100"] == 25 and got["low_prob_frac"] == 0.25
    none = X.unpacked(spark.range(1), [], X.timing_features(F.filter(w, lambda x: F.lit(False)), F.lit(60.0))).first().asDict()
    assert none["n_words"] == 0 and none["wpm"] == 0 and none["pause_mean"] is None


def test_edits_and_stems(spark):
    rows = spark.createDataFrame([(1, ["i", "am", "fine"], ["i", "am", "fine"]), (2, ["a", "b", "c"], ["a", "x", "c", "d"]), (3, [], []), (4, None, ["a"]), (5, "i walked in the hall".split(), "he walks at hall".split())], "k int, a array<string>, b array<string>").withColumn("steps", diff.script("a", "b"))
    cols = lambda fn: [c.alias(n) for n, c in fn(F.col("a"), F.col("b"), F.col("steps")).items()]
    e = {r.k: r for r in rows.select("k", *cols(diff.edit_rates)).collect()}
    assert (e[1].change_rate, e[1].ratio) == (0, 1.0) and (e[3].ratio, e[3].len_ratio) == (1.0, 0.0) and e[4].ins_per100 == 100
    assert tuple(e[2])[1:5] == pytest.approx((200 / 3, 100 / 3, 0.0, 100 / 3))
    r = {x.k: x for x in rows.select("k", *cols(diff.repairs)).collect()}
    # i, he are pronouns; in, at prepositions; the an article; walked and walks share a stem
    assert tuple(r[5])[1:] == (20, 0, 40, 40, 20, 120) and r[1].total == 0
    stems = spark.createDataFrame([("walk", "walked"), ("go", "goes"), ("chair", "chairs"), ("walk", "walk")], "x string, y string").select(diff.same_stem(F.col("x"), F.col("y")).alias("s"))
    assert [x.s for x in stems.collect()] == [True, False, True, False]


def test_lpt_shards_deals_equal_sizes_evenly(spark):
    from scorefabric.operators import folds

    got = folds.lpt_shards(spark.range(1000).select("id", F.lit(7).alias("size")), "id", "size", 8).groupBy("shard").count().collect()
    assert {r["count"] for r in got} == {125} and len(got) == 8
    rows = [(1, 5), (2, 9), (3, None), (4, 9), (5, 1)]
    got = {r.k: r.shard for r in folds.lpt_shards(spark.createDataFrame(rows, "k int, size int"), "k", "size", 5).collect()}
    assert {got[2], got[4]} == {0, 1} and (got[1], got[5], got[3]) == (2, 3, 4)


def test_ctc(spark):
    f = spark.createDataFrame([(1, i, p, 0.5) for i, p in enumerate(["_", "▁a", "▁a", "_", "▁a", "b"])], "k int, pos int, piece string, c double")
    got = sequences.ctc_words(f, ["k"], "pos", "piece", "c", "_").orderBy("start").collect()
    assert [(r.word, round(r.start, 2), round(r.end, 2)) for r in got] == [("a", 0.08, 0.16), ("ab", 0.32, 0.48)]


def test_frames_chunks_and_pauses(spark):
    assert len(one(spark, sequences.frames_of(F.array_repeat(F.lit(0.1), 800)))) == 3
    assert [len(c) for c in one(spark, sequences.chunks(F.array_repeat(F.lit(0.0), 70), 30, 15))] == [30, 30]
    f = spark.createDataFrame([(1, i, a) for i, a in enumerate([False, True, False, False, False, True, False])], "k int, pos int, active boolean")
    assert sequences.inactive_runs(f, ["k"], "pos", "active", 3).first()["pause_max"] == 3


def test_components_do_not_depend_on_order(spark):
    nodes = spark.range(8).withColumnRenamed("id", "n")
    for e in ([(0, 1), (1, 2), (5, 4)], [(4, 5), (2, 1), (1, 0)]):
        got = {r.n: r.component for r in similarity.components(spark.createDataFrame(e, "a long, b long"), nodes, "n").collect()}
        assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 6))
def test_greedy_folds(seed, k):
    c = np.random.default_rng(seed).integers(0, 5, (30, 3)).astype(float)
    f = folds.greedy_folds(c, k, seed)
    assert f.min() >= 0 and f.max() < k and len(f) == 30


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6))
def test_nnls_conditions(seed):
    r = np.random.default_rng(seed)
    a, y = r.normal(size=(60, 6)), r.normal(size=60)
    c, v = a.T @ a / 60, a.T @ y / 60
    w = models.nnls(c, v)
    g = v - c @ w
    assert (w >= 0).all() and (g <= 1e-8).all() and abs(g @ w) < 1e-8


def test_dual_ridge_is_primal_ridge():
    r = np.random.default_rng(0)
    x, y = r.normal(size=(50, 8)), r.normal(size=50)
    z = models.standardised(x)
    p = models.ridge_predict(models.gram(z), models.gram(z), y, np.array([0.3]))[0]
    w = np.linalg.solve(z.T @ z + 0.3 * 8 * np.eye(8), z.T @ (y - y.mean()))
    assert np.allclose(p, z @ w + y.mean())
    loo = []
    for a in models.ALPHAS:
        e = 0.0
        for i in range(50):
            k = np.delete(np.arange(50), i)
            g = models.gram(z)
            e += (models.ridge_predict(g[np.ix_(k, k)], g[i : i + 1][:, k], y[k], np.array([a]))[0, 0] - y[i]) ** 2
        loo.append(e)
    # rows left out keep their part in the centring, so the errors, and not the places, are what agrees
    assert loo[models.ridge_loo(models.gram(z), y)] <= 1.01 * min(loo)


def test_contracts(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, float("nan"))], "k int, v double")
    assert contracts.duplicates(df, ["k"]).isEmpty() and contracts.not_finite(df, ["v"]).count() == 1
    with pytest.raises(contracts.ContractError):
        sinks.submission(df, df, "k", "v", str(tmp_path / "s"))
    good = spark.createDataFrame([(1, 2.0), (2, 0.0)], "k int, v double")
    sinks.submission(good, df, "k", "v", str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).count() == 2


def test_strat_folds_are_pure(spark):
    df = spark.createDataFrame([(i % 13, i % 3) for i in range(200)], "g int, s int")
    f = folds.stratified_group_folds(df, "g", "s", 4, 2)
    assert f.count() == 26 and contracts.groups_across(df.join(f.where("repeat = 0"), "g"), "g", "fold").where("folds > 1").isEmpty()
    assert f.groupBy("g", "repeat").count().where("count > 1").isEmpty()


def test_composite_identity():
    assert abs((0.5096 + 1 - 0.8647) / 2 - 0.3224) < 1e-4


def test_sources(spark, tmp_path):
    (tmp_path / "asr.jsonl").write_text(json.dumps({"split": "train", "filename": "a.wav", "words": [[0.0, 0.5, "hi", 0.9]]}) + "\n")
    r = readers.jsonl_asr(spark, str(tmp_path / "asr.jsonl")).first()
    assert r.words[0].word == "hi" and r.segments is None
    (tmp_path / "judge_x.csv").write_text("filename,v\na,1\n")
    assert readers.by_view(spark, str(tmp_path / "judge_*.csv"), "judge", "filename string, v int").first()["view"] == "x"
    b = io.BytesIO()
    with wave.open(b, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes((np.ones(1600, "<i2") * 16384).tobytes())
    (tmp_path / "a.wav").write_bytes(b.getvalue())
    got = readers.wav(spark, str(tmp_path / "a.wav")).first()
    assert (got.sr, got.channels, got.duration, len(got.samples)) == (8000, 2, 0.1, 1600) and abs(got.samples[5] - 0.5) < 1e-6
    np.savez(tmp_path / "e.npz", mean=np.arange(6.0).reshape(2, 3))
    assert [list(x.vec) for x in readers.npz_arrays(spark, str(tmp_path / "e.npz"), ["mean", "std"]).orderBy("row").collect()] == [[0, 1, 2], [3, 4, 5]]


def test_stages(spark, tmp_path):

    s = Stages(spark, str(tmp_path))
    s.stage("a")(lambda sp: sp.range(3))
    s.stage("b", "a")(lambda sp, a: a.selectExpr("id * 2 as x"))
    assert [r.x for r in s.run("b")["b"].orderBy("x").collect()] == [0, 2, 4] and s.done("a")


def test_streamed_sessions(spark, tmp_path):
    from scorefabric.streaming import sessions

    src = spark.createDataFrame([("u", f"2024-01-01 00:{m:02d}:00", 1.0) for m in (0, 1, 2, 30, 59)], "k string, t string, v double").selectExpr("k", "cast(t as timestamp) ts", "v")
    src.write.parquet(str(tmp_path / "in"))
    q = sessions.follow(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), "ts", "1 minute", "5 minutes", ["k"], "v", str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_bootstrap_of_equal_models(spark):
    df = spark.createDataFrame([(i % 7, float(i % 5), float(i % 5) + 0.1 * (i % 3)) for i in range(70)], "g int, y double, p double").withColumn("q", F.col("p"))
    r = stats.paired(stats.bootstrap(df, "g", "y", ["p", "q"], 50), "p", "q").first()
    assert r.rmse_ci == [0.0, 0.0] and r.p_better_rmse == 0.0


def test_average_linkage():
    r = np.random.default_rng(2)
    x = r.normal(size=(24, 5))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    groups = [[i] for i in range(24)]
    while len(groups) > 1:
        h, a, b = min((np.mean([d[i, j] for i in groups[a] for j in groups[b]]), a, b) for a in range(len(groups)) for b in range(a))
        if h >= 1 - 0.4:
            break
        groups[b] += groups.pop(a)
    got = similarity.average_linkage(x, [0.4])[0]
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(got == v).tolist()) for v in set(got.tolist())}


def test_svr_keeps_errors_within_epsilon():
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 3))
    y = np.sin(x[:, 0]) + 2
    k = models.rbf(x, x, 0.5)
    p = models.svr(k, k, y, c=100.0, eps=0.1)
    assert np.abs(p - y).max() < 0.15
    assert len(models.pca_svr(x, np.arange(50), np.arange(50, 60), y[:50], 2)) == 10


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abcdefg"), max_size=40), st.integers(1, 12))
def test_moving_ttr(toks, window):
    from scorefabric.functions.lexical import moving_ttr

    n = len(toks)
    spans = [toks[i : i + window] for i in range(n - window + 1)] if n > window else [toks]
    want = sum(len(set(s)) / len(s) for s in spans) / len(spans) if n else 0.0
    assert abs(moving_ttr(toks, window) - want) < 1e-9


def test_half_is_numpy_s(spark):
    x = [0.0, 1.0, -0.1, 65504.0, 65519.0, 65520.0, 6e-8, 2e-8, 3.1e-5, 1 / 3, 2049.0, 2051.0, float("inf"), None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(X.half(F.col("x"))).collect()]
    want = [None if v is None else float(np.float16(v)) for v in x]
    assert got == want


def test_activity_of_silence_and_of_nothing(spark):
    df = spark.createDataFrame([(1, [-90.0, -90.0]), (2, []), (3, [-80.0, -10.0, -80.0, -80.0, -80.0, -12.0, -80.0])], "k int, l array<double>")
    a, b, c = X.unpacked(df, ["k"], sequences.activity(F.col("l"), 0.1)).orderBy("k").collect()
    assert (a["lead_sil"], a["trail_sil"], a["active_ratio"], a["n_pauses"]) == (0.2, 0.2, 0.0, 0)
    assert b["dyn_range_db"] is None and b["active_ratio"] is None and b["lead_sil"] == 0
    assert (c["n_pauses"], c["lead_sil"], c["trail_sil"]) == (1, 0.1, 0.1) and c["pause_max"] == pytest.approx(0.3)


def test_syntax_of_a_parse(spark):
    row = lambda w, s, pos, tag, dep, head: (w, s, pos, tag, dep, head)
    p = [row("Dogs", 0, "NOUN", "NNS", "nsubj", 2), row("ran", 0, "VERB", "VBD", "ROOT", 2), row("because", 0, "SCONJ", "IN", "mark", 5), row("it", 0, "PRON", "PRP", "nsubj", 5), row("rained", 0, "VERB", "VBD", "advcl", 2), row(".", 0, "PUNCT", ".", "punct", 2), row("!", 1, "PUNCT", ".", "ROOT", 7), row("Yes", 2, "INTJ", "UH", "ROOT", 8)]
    df = spark.createDataFrame([(1, p), (2, [])], "k int, p array<struct<word:string,sent:int,pos:string,tag:string,dep:string,head:int>>")
    a, b = X.unpacked(df, ["k"], syntax.syntax_features(F.col("p"), F.lit(2))).orderBy("k").collect()
    assert (a["ling_n_words"], a["n_sents"], a["sent_len_mean"], a["sent_len_std"], a["dep_depth_max"], a["dep_depth_mean"]) == (6, 2, 3.0, 2.0, 2, 1.0)
    assert (a["clauses_per_sent"], a["noun_chunks_per_sent"], a["verb_form_diversity"], a["vtag_VBD"]) == (0.5, 1.0, 1, 2 / 6)
    assert b["ling_n_words"] == 0 and b["ttr"] is None and b["n_sents"] is None


def _tree_mean(node, x, known):
    if "value" in node:
        return node["value"]
    if node["feature"] in known:
        return _tree_mean(node["left" if x[node["feature"]] <= node["threshold"] else "right"], x, known)
    return sum(_tree_mean(node[s], x, known) * node[s]["cover"] for s in ("left", "right")) / node["cover"]


def test_shapley_values_are_those_of_all_subsets():
    from itertools import combinations
    from math import factorial

    rng = np.random.default_rng(3)

    def grown(depth, cover):
        if not depth or cover < 2:
            return {"value": float(rng.normal()), "cover": cover}
        left = float(rng.integers(1, int(cover)))
        return {"feature": int(rng.integers(4)), "threshold": float(rng.normal() / 2), "cover": cover, "left": grown(depth - 1, left), "right": grown(depth - 1, cover - left)}

    tree, x = grown(5, 200.0), rng.normal(size=(6, 4))
    got = attribution.shapley(x, attribution.leaves(tree))
    for row, phi in zip(x, got, strict=True):
        for j in range(4):
            rest = [i for i in range(4) if i != j]
            want = sum(factorial(k) * factorial(3 - k) / 24 * (_tree_mean(tree, row, {*s, j}) - _tree_mean(tree, row, set(s))) for k in range(4) for s in combinations(rest, k))
            assert phi[j] == pytest.approx(want)
        assert attribution.expected(attribution.leaves(tree)) + phi.sum() == pytest.approx(_tree_mean(tree, row, {0, 1, 2, 3}))


def test_contributions_of_fitted_trees_add_up_and_seeds_average(spark):
    from pyspark.ml.feature import VectorAssembler

    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).cast("double").alias("b")).withColumn("y", F.col("a") * 2 - F.col("b"))
    v = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    model = models.boosted_trees(label="y", trees=3, rate=0.3).fit(v)
    paths = attribution.fitted_leaves(model)
    sums = attribution.contributions(df, paths, ["id"], ["a", "b"]).groupBy("id").agg(F.sum("contribution").alias("s"))
    both = model.transform(v).join(sums, "id").select("prediction", "s").collect()
    assert len(both) == 200 and all(r["prediction"] == pytest.approx(attribution.expected(paths) + r["s"]) for r in both)
    makers = [models.boosted_trees(label="y", trees=2, seed=s) for s in (1, 2)]
    single = [{r["id"]: r["prediction"] for r in m.fit(v).transform(v).collect()} for m in makers]
    mean = {r["id"]: r["pred"] for r in models.seed_averaged(makers, v, v, "id").collect()}
    assert all(mean[i] == pytest.approx((single[0][i] + single[1][i]) / 2) for i in mean)


def test_ridge_search_is_leave_one_out_by_refitting(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(40, 3)) * [1, 5, 0.1], rng.normal(size=40)
    y = y + x[:, 0]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y double")
    got = {round(r["alpha"], 9): r["loo_mse"] for r in models.ridge_search(df, ["a", "b", "c"], "y").collect()}
    z = (x - x.mean(0)) / x.std(0)
    for alpha in models.SEARCH[[0, 14, 29]]:
        err = 0.0
        for i in range(40):
            keep = np.arange(40) != i
            zt = np.column_stack([np.ones(39), z[keep]])
            w = np.linalg.solve(zt.T @ zt + np.diag([0, alpha, alpha, alpha]), zt.T @ y[keep])
            err += (y[i] - w[0] - z[i] @ w[1:]) ** 2 / 40
        assert got[round(float(alpha), 9)] == pytest.approx(err)


def test_ranks_within_groups(spark):
    rows = [(g, float(v)) for g in "ab" for v in [3, 1, 1, 2, 2, 2, 9]]
    df = spark.createDataFrame(rows, "g string, v double")
    got = sorted(map(tuple, stats.ranks_by_count(df, "v", "r", ["g"]).select("g", "v", "r").collect()))
    assert got == sorted(map(tuple, stats.ranks(df, "v", "r", ["g"]).select("g", "v", "r").collect()))


def test_alignment_refuses_a_miss(spark):
    rows = spark.createDataFrame([(1,), (2,)], "k int")
    with pytest.raises(contracts.ContractError):
        contracts.aligned(rows, spark.createDataFrame([(1, 0.5)], "k int, v double"), ["k"])


def test_stages_try_again_in_slots(spark, tmp_path):
    tries = {"n": 0}
    s = Stages(spark, str(tmp_path))

    @s.stage("a")
    def a(spark):
        tries["n"] += 1
        if tries["n"] < 3:
            raise OSError("not yet")
        return spark.range(3)

    @s.stage("b")
    def b(spark):
        return spark.range(2)

    @s.stage("c", "a", "b")
    def c(spark, a, b):
        return a.join(b, "id")

    assert s.run("c", slots=2, retries=2)["c"].count() == 2 and tries["n"] == 3


def test_names_and_candidates(spark):
    names = ["x_a", "x_b_mean", "y_a", "x_id"]
    assert X.names_like(names, prefix=("x_",), deny=("x_id",)) == ["x_a", "x_b_mean"]
    assert X.names_like(names, suffix=("_mean",)) == ["x_b_mean"] and X.names_like(names, include=("_a",), exclude=("y",)) == ["x_a"]
    c = F.expr("array(named_struct('code','b','p',0.5D), named_struct('code','a','p',0.5D), named_struct('code','z','p',null), named_struct('code','c','p',0.9D))")
    assert [r["code"] for r in one(spark, X.top_candidates(c, "p", 3))] == ["c", "a", "b"]
