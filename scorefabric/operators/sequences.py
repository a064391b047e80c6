"""Ordered sequences: gaps, islands, runs, collapse of symbol streams, frames and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorefabric.functions.expressions import let, packed, quantile_of


def gaps(df: DataFrame, key: list[str], start: str, end: str, order: list[str] | None = None) -> DataFrame:
    """gap: time from the end of the row before, never below 0; null for the first row of a key."""
    w = Window.partitionBy(*key).orderBy(*(order or [start]))
    return df.withColumn("gap", F.greatest(F.col(start) - F.lag(end).over(w), F.lit(0.0)))


def islands(df: DataFrame, key: list[str], order: list[str], cut: Column) -> DataFrame:
    """island: number of rows so far that open a new run (cut holds there)."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("island", F.sum(F.when(cut, 1).otherwise(0)).over(w))


def run_features(df: DataFrame, key: list[str], start: str, end: str, order: list[str], thresholds: list[float]) -> DataFrame:
    """Pauses at thresholds and run lengths between pauses of the first threshold or more; one shuffle by key for all."""
    g = islands(gaps(df, key, start, end, order), key, order, F.col("gap") >= thresholds[0])
    runs = g.groupBy(*key, "island").agg(F.count(F.lit(1)).alias("_len"), *[F.count(F.when(F.col("gap") >= t, 1)).alias(f"_p{k}") for k, t in enumerate(thresholds)], F.sum(F.when(F.col("gap") >= thresholds[0], F.col("gap"))).alias("_sum"), F.max("gap").alias("_max"))
    return runs.groupBy(*key).agg(F.sum("_len").alias("n"), *[F.sum(f"_p{k}").alias(f"pauses_{k}") for k in range(len(thresholds))], F.coalesce(F.sum("_sum") / F.sum("_p0"), F.lit(0.0)).alias("pause_mean"), F.coalesce(F.max("_max"), F.lit(0.0)).alias("pause_max"), F.avg("_len").alias("mean_run"), F.max("_len").alias("max_run"))


def inactive_runs(frames: DataFrame, key: list[str], pos: str, active: str, least: int) -> DataFrame:
    """Pauses: runs of inactive frames strictly between the first and the last active one, `least` frames or more."""
    w = Window.partitionBy(*key)
    inner = frames.withColumn("_f", F.min(F.when(F.col(active), F.col(pos))).over(w)).withColumn("_l", F.max(F.when(F.col(active), F.col(pos))).over(w)).where((F.col(pos) > F.col("_f")) & (F.col(pos) < F.col("_l")))
    o = w.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    runs = inner.withColumn("_i", F.sum(F.col(active).cast("int")).over(o)).where(~F.col(active)).groupBy(*key, "_i").agg(F.count(F.lit(1)).alias("len")).where(F.col("len") >= least)
    return runs.groupBy(*key).agg(F.count(F.lit(1)).alias("n_pauses"), F.sum("len").alias("pause_total"), F.max("len").alias("pause_max"))


def repetition(df: DataFrame, key: list[str], order: list[str], token: str) -> DataFrame:
    """Per key: immediate repeats, and bigrams equal to the one two places before."""
    w = Window.partitionBy(*key).orderBy(*order)
    lag = lambda k: F.lag(token, k).over(w)
    hit = df.withColumn("_r", (F.col(token) == lag(1)).cast("int")).withColumn("_b", ((F.col(token) == lag(2)) & (lag(1) == lag(3))).cast("int"))
    return hit.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_r"), F.lit(0)).alias("repeats"), F.coalesce(F.sum("_b"), F.lit(0)).alias("bigram_repeats"))


def collapse(df: DataFrame, key: list[str], order: list[str], symbol: str, blank) -> DataFrame:
    """Rows that stay when repeats of the row before and blanks go (a blank separates equal symbols)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_prev", F.lag(symbol).over(w)).where((F.col("_prev").isNull() | (F.col(symbol) != F.col("_prev"))) & (F.col(symbol) != F.lit(blank))).drop("_prev")


def ctc_words(frames: DataFrame, key: list[str], pos: str, piece: str, confidence: str, blank: str, seconds: float = 0.08, mark: str = "▁") -> DataFrame:
    """Words of a frame-wise best path: collapsed pieces, joined from one that starts with the mark to the next."""
    kept = collapse(frames, key, [pos], piece, blank)
    w = Window.partitionBy(*key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    words = kept.withColumn("_w", F.sum(F.col(piece).startswith(mark).cast("int")).over(w)).groupBy(*key, "_w").agg(F.array_sort(F.collect_list(F.struct(pos, piece))).alias("_p"), (F.min(pos) * seconds).alias("start"), ((F.max(pos) + 1) * seconds).alias("end"), F.avg(confidence).alias("prob"))
    return words.withColumn("word", F.replace(F.array_join(F.transform("_p", lambda x: x[piece]), ""), F.lit(mark), F.lit(""))).where("word <> ''").drop("_p", "_w")


def frames_of(samples: Column, win: int = 400, hop: int = 160) -> Column:
    """dBFS of sliding frames; samples shorter than a frame are padded with zeros."""
    n = F.greatest(F.size(samples), F.lit(win))
    count = F.floor((n - win) / hop).cast("int")
    level = lambda i: F.sqrt(F.aggregate(F.slice(samples, i * hop + 1, win), F.lit(0.0), lambda a, x: a + x.cast("double") * x) / win + 1e-12)
    return F.transform(F.sequence(F.lit(0), count), lambda i: 20 * F.log10(level(i) + 1e-12))


def energy_features(samples: Column) -> dict[str, Column]:
    x = F.transform(samples, lambda s: F.abs(s.cast("double")))
    return {"peak": F.array_max(x), "clip_frac": F.size(F.filter(x, lambda s: s > 0.999)) / F.size(x), "frames": frames_of(samples)}


def activity(levels: Column, hop: float = 0.01, below: float = 25.0, floor: float = -55.0, least: float = 0.3) -> Column:
    """Levels of a clip's frames (dB) to a struct of quantiles, active time, silence at the ends and inner pauses of `least` seconds.

    A frame is active above max(p90 - below, floor). Without an active frame, both ends have the clip's length; without
    frames, quantiles and the ratio are null.
    """
    quantiles = let(F.array_sort(levels), lambda o: F.struct(*[quantile_of(o, q).alias(f"p{round(100 * q)}") for q in (0.1, 0.5, 0.9)]))
    above = lambda q: F.filter(F.transform(levels, lambda x, i: F.when(x > F.greatest(q["p90"] - below, F.lit(floor)), i)), lambda i: i.isNotNull())
    rest = lambda act: F.greatest(F.size(act) - 1, F.lit(0))
    runs = lambda act: F.zip_with(F.slice(act, 2, rest(act)), F.slice(act, 1, rest(act)), lambda b, a: (b - a - 1) * F.lit(hop))

    def build(s):
        n, k, q = F.size(levels), F.size(s["act"]), s["q"]
        pauses = F.filter(runs(s["act"]), lambda r: r >= least)
        return {
            "noise_floor_db": q["p10"],
            "median_db": q["p50"],
            "speech_level_db": q["p90"],
            "dyn_range_db": q["p90"] - q["p10"],
            "active_ratio": F.when(n > 0, k / n),
            "active_sec": k * F.lit(hop),
            "lead_sil": F.when(k > 0, F.get(s["act"], F.lit(0))).otherwise(n) * F.lit(hop),
            "trail_sil": F.when(k > 0, n - 1 - F.get(s["act"], k - 1)).otherwise(n) * F.lit(hop),
            "n_pauses": F.size(pauses),
            "pause_total": F.aggregate(pauses, F.lit(0.0), lambda a, x: a + x),
            "pause_max": F.coalesce(F.array_max(pauses), F.lit(0.0)),
        }

    return let(let(quantiles, lambda q: F.struct(q.alias("q"), above(q).alias("act"))), lambda s: packed(build(s)))


def chunks(samples: Column, size: int, tail: int) -> Column:
    """Tumbling chunks; a last one shorter than `tail` goes unless it is the first."""
    n = F.greatest(F.ceil(F.size(samples) / size).cast("int"), F.lit(1))
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(samples, i * size + 1, size))
    return F.filter(each, lambda c, i: (i == 0) | (F.size(c) >= tail))


def pooled(df: DataFrame, key: list[str], vector: str, weight: str | None = None) -> DataFrame:
    """Element-wise (weighted) mean and sample sd over a key's vectors, by position: sums combine before the shuffle."""
    w = F.col(weight) if weight else F.lit(1.0)
    e = df.select(*key, w.alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    m = e.groupBy(*key, "_i").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_m"), F.stddev_samp("_x").alias("_s"))
    return m.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_i", "_m", "_s"))).alias("_a")).select(*key, F.transform("_a", lambda s: s["_m"]).alias("mean"), F.transform("_a", lambda s: s["_s"]).alias("std"))


def masked_pooled(df: DataFrame, key: list[str], position: str | None, duration: str | None, vector: str, chunk: int = 375, seconds: float = 30.0, rate: float = 12.5) -> DataFrame:
    """(key, n, mean, sd): element-wise mean and population sd over a key's valid frame states, a row each.

    Every chunk of frames covers so many seconds; of each the first ceil(its seconds * rate) are valid, as far as the
    duration goes. Without a position all are. Sums by place combine before the shuffle. A key without a valid frame has
    no row; null vectors and null elements are left out.
    """
    rows = df.where(F.col(vector).isNotNull())
    if position:
        p = F.col(position)
        left = F.least(F.lit(seconds), F.greatest(F.col(duration) - seconds * F.floor(p / chunk), F.lit(0.0)))
        rows = rows.where(p % chunk < F.least(F.lit(chunk), F.ceil(left * rate)))
    e = rows.select(*key, F.posexplode(vector).alias("_i", "_x")).withColumn("_x", F.col("_x").cast("double"))
    m = e.groupBy(*key, "_i").agg(F.count(F.lit(1)).alias("_n"), F.avg("_x").alias("_m"), F.stddev_pop("_x").alias("_s"))
    by = m.groupBy(*key).agg(F.max("_n").alias("n"), F.array_sort(F.collect_list(F.struct("_i", "_m", "_s"))).alias("_a"))  # an entry a place
    return by.select(*key, "n", F.transform("_a", lambda s: s["_m"]).alias("mean"), F.transform("_a", lambda s: s["_s"]).alias("sd"))
