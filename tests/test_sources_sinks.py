"""16-bit arrays, results that survive a failure, language records, and word error rates of long texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorefabric.functions import expressions as X
from scorefabric.sources import readers, sinks


def test_halves_are_numpy_s(spark, tmp_path):
    r = np.random.default_rng(0)
    x = [*(r.normal(size=(30, 9)) * 10.0 ** r.integers(-9, 6, (30, 9))).tolist(), [], None, [None, 1.0, 70000.0, -0.0]]
    df = spark.createDataFrame(list(enumerate(x)), "id int, v array<double>").withColumn("layer", F.col("id") % 2)
    sinks.to_arrays(df, str(tmp_path / "a"), halves=("v",))
    back = spark.read.parquet(str(tmp_path / "a"))
    assert back.schema["v"].dataType.simpleString() == "binary"
    got = {g.id: g.v for g in sinks.unpacked_halves(back, ["v"]).collect()}
    for i, v in enumerate(x):
        if v is None:
            assert got[i] is None
            continue
        with np.errstate(over="ignore"):
            want = np.array([np.nan if e is None else e for e in v]).astype(np.float16).astype(float)
        assert np.array_equal(np.array(got[i], float), want, equal_nan=True)


def test_partial_results_survive_a_failure(spark, tmp_path):
    """The run ends in its third batch; the next call leaves neither gaps nor doubles, and a further one adds new files alone."""
    source, out, progress = (str(tmp_path / p) for p in ("in", "out", "progress"))
    for k in range(5):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    # files come in the order of their times
    late = F.when(F.col("id") == 25, F.raise_error(F.lit("lost"))).otherwise(F.col("id") + 1)

    with pytest.raises(Exception):
        sinks.resumed(spark, source, "id long", lambda df: df.select("id", late.cast("long").alias("x")), out, progress)
    done = spark.read.parquet(out).count()
    assert 0 < done < 50
    sinks.resumed(spark, source, "id long", lambda df: df.select("id", (F.col("id") + 1).alias("x")), out, progress)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(50))
    spark.range(50, 55).coalesce(1).write.mode("append").parquet(source)
    sinks.resumed(spark, source, "id long", lambda df: df.select("id", (F.col("id") + 1).alias("x")), out, progress)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(55))


def test_language_records(spark):
    rows = ['{"lang": "de", "prob": 0.5, "top5": [{"code": "de", "prob": 0.5}]}', '{"error": "no speech"}', "not json", None, '{"lang": "fr", "error": "late"}', "{}"]
    got = readers.language_ids(spark.createDataFrame(list(enumerate(rows)), "id int, record string"), "record").orderBy("id").collect()
    assert [(g.lang, g.error) for g in got] == [("de", None), (None, "no speech"), (None, "unreadable record"), (None, None), (None, "late"), (None, "unreadable record")]
    assert got[0].top5[0].code == "de" and got[0].prob == 0.5


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_wer_of_many_words(spark):
    r = random.Random(0)
    words = [f"w{i}" for i in range(90)]
    pairs = [([r.choice(words) for _ in range(r.randint(0, 60))], [r.choice(words) for _ in range(r.randint(0, 60))]) for _ in range(40)] + [([], []), ([], ["a"]), (["a"], []), (None, ["a"])]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = {g.i: g.w for g in df.select("i", X.wer(F.col("a"), F.col("b")).alias("w")).collect()}
    for i, (a, b) in enumerate(pairs):
        want = None if a is None else (edits(a, b) / len(a) if a else float(bool(b)))
        assert got[i] == pytest.approx(want) if want is not None else got[i] is None
    # more different words than the first plane has code points
    long = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(69_999)), lambda k: F.concat(F.lit("x"), k.cast("string"))).alias("a"), F.array(F.lit("y"), F.lit("x69999")).alias("b"))
    assert long.select(X.wer(F.col("a"), F.col("b")).alias("w")).first().w == 69_999 / 70_000


def test_dropped_columns(spark):
    df = spark.range(1).selectExpr("id", "1 as a", "2 as b")
    assert X.dropped(df, ["a", "zz"], missing_ok=True).columns == ["id", "b"]
    with pytest.raises(KeyError):
        X.dropped(df, ["zz"])


def test_discovery_and_reports(spark, tmp_path):
    for name in ("x/one.txt", "x/two.csv", "skip/three.txt", "y/four.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("abc")
    found = readers.discover(spark, [str(tmp_path)], "*.txt", "/skip/").collect()
    assert sorted(r.path.rsplit("/", 1)[1] for r in found) == ["four.txt", "one.txt"] and {r.length for r in found} == {3}
    df = spark.createDataFrame([(1, {"k": 2})], "a int, m map<string,int>")
    assert sinks.to_report(df) == '[{"a": 1, "m": {"k": 2}}]'
    with pytest.raises(ValueError):
        sinks.to_report(spark.range(11), limit=10)


def test_inner_folds_keep_groups_and_sizes_even():
    from scorefabric.operators.folds import group_folds

    r = random.Random(1)
    sizes = {f"g{i}": r.randint(1, 30) for i in range(60)}
    fold = group_folds(sizes, 4)
    loads = [sum(n for g, n in sizes.items() if fold[g] == f) for f in range(4)]
    assert set(fold) == set(sizes) and max(loads) - min(loads) <= 30
    assert group_folds({"a": 3}, 4) == {"a": 0}
