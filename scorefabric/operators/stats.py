"""Aggregates: profiles, metrics, rank correlation, histograms, cohort reports, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorefabric.operators.quantiles import quantiles
from scorefabric.operators.written import checkpointed

QUARTILES = [0.25, 0.5, 0.75]


def describe(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, sample sd, min, exact quartiles, max."""
    by = by or []
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))
    q = quantiles(df, value, QUARTILES, by).drop("n").withColumnsRenamed({k: f"_{k}" for k in by})
    both = out.join(q, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by] or None, "left")
    return both.select(*by, "n", "mean", "sd", "low", *[F.get("q", F.lit(k)).alias(f"q{int(100 * p)}") for k, p in enumerate(QUARTILES)], "high")


def value_counts(df: DataFrame, column: str, normalise: bool = False) -> DataFrame:
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    if normalise:
        all_ = df.agg(F.count(F.lit(1)).alias("_all"))
        out = out.join(F.broadcast(all_)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")  # one row
    return out


def count_maps(df: DataFrame, by: str, column: str) -> DataFrame:
    """(by, counts): how often each value of a column occurs, as a map; nulls are not counted."""
    n = df.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(column, "_n"))).alias("counts"))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(F.avg((p - y) * (p - y)))


def metrics(y: str, p: str) -> list[Column]:
    """n, rmse, mae, bias, Pearson r and the composite (rmse + 1 - r) / 2."""
    a, b = F.col(y), F.col(p)
    r = F.corr(a, b)
    return [F.count(F.lit(1)).alias("n"), rmse(a, b).alias("rmse"), F.avg(F.abs(b - a)).alias("mae"), F.avg(b - a).alias("bias"), r.alias("r"), ((rmse(a, b) + 1 - r) / 2).alias("composite")]


def ranks(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Average ranks within groups `by` (a group is one task: give one, or pre-filter, where a table is large)."""
    w = Window.partitionBy(*(by or [])).orderBy(value)
    ties = Window.partitionBy(*(by or []), value)
    return df.withColumn(out, F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def ranks_by_count(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Average ranks (within groups `by`) without bringing a group to one task: counts of distinct values are summed over ranges.

    Rows with a null value or group are left out.
    """
    by = by or []
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranged = checkpointed(counts.repartitionByRange(*by, F.col(value)).withColumn("_p", F.spark_partition_id()))
    own = Window.partitionBy(*by).orderBy("_p")
    before = ranged.groupBy(*by, "_p").agg(F.sum("_n").alias("_t")).withColumn("_b", F.sum("_t").over(own) - F.col("_t")).drop("_t")
    inside = F.sum("_n").over(Window.partitionBy(*by, "_p").orderBy(value)) - F.col("_n")
    placed = ranged.withColumn("_i", inside)
    table = (placed.join(before, [*by, "_p"]) if by else placed.join(F.broadcast(before), "_p")).select(*by, value, (F.col("_b") + F.col("_i") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(table, [*by, value])


def spearman(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Rank correlation of every feature with the label, nulls left out pairwise: (feature, n, rho)."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features]
    long = df.select(F.explode(F.array(*pairs)).alias("f"), F.col(label).cast("double").alias("y")).select("f.feature", "f.x", "y").where("x is not null and y is not null and not isnan(x)")
    r = ranks_by_count(ranks_by_count(long, "x", "rx", ["feature"]), "y", "ry", ["feature"])
    return r.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho"))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts and column shares."""
    t = df.groupBy(row).pivot(column, values).count().na.fill(0)
    sums = [F.sum(F.col(str(v))).over(Window.partitionBy(F.lit(1))).alias(f"_s{k}") for k, v in enumerate(values)]
    t = t.select("*", *sums)  # as many rows as `row` has values
    return t.select(row, *[F.col(str(v)).alias(f"n_{v}") for v in values], *[(F.col(str(v)) / F.col(f"_s{k}")).alias(f"share_{v}") for k, v in enumerate(values)])


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n, density) of equal bins; the last is closed."""
    width = (high - low) / bins
    b = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    out = df.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("density", F.col("n") / (F.sum("n").over(Window.partitionBy(F.lit(1))) * width))


def cohort_profile(df: DataFrame, cohort: str, y: str, p: str) -> DataFrame:
    return df.groupBy(cohort).agg(*metrics(y, p))


def test_mix_rmse(scored: DataFrame, target: DataFrame, cohort: str, y: str, p: str) -> DataFrame:
    """Square root of the cohorts' squared errors weighted by the cohorts' shares in another table."""
    mse = scored.groupBy(cohort).agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("mse"))
    share = target.groupBy(cohort).agg(F.count(F.lit(1)).alias("k"))
    return mse.join(share, cohort).agg(F.sqrt(F.sum(F.col("mse") * F.col("k")) / F.sum("k")).alias("test_mix_rmse"))


def quantile_buckets(df: DataFrame, value: str, out: str) -> DataFrame:
    """Quartile buckets 0..3, right-closed with the lowest included, from exact quartiles (one row, broadcast)."""
    q = quantiles(df, value, QUARTILES).select(F.col("q").alias("_q"))
    b = F.when(F.col(value) <= F.col("_q")[0], 0).when(F.col(value) <= F.col("_q")[1], 1).when(F.col(value) <= F.col("_q")[2], 2).otherwise(3)
    return df.join(F.broadcast(q), how="left").withColumn(out, F.when(F.col(value).isNotNull(), b)).drop("_q")


def recalibrated(df: DataFrame, cohort: str, y: str, p: str, least: int = 20) -> DataFrame:
    """p made linear in y per cohort where it has more than `least` rows."""
    fit = df.groupBy(cohort).agg(F.count(F.lit(1)).alias("_n"), F.regr_slope(y, p).alias("_s"), F.regr_intercept(y, p).alias("_c"))
    return df.join(fit, cohort).withColumn("calibrated", F.when(F.col("_n") > least, F.col("_s") * F.col(p) + F.col("_c")).otherwise(F.col(p))).drop("_n", "_s", "_c")


def bootstrap(df: DataFrame, group: str, y: str, preds: list[str], n: int = 1000, seed: int = 0) -> DataFrame:
    """Metrics of n draws of groups with replacement: (draw, model, n, rmse, r, composite).

    Groups are reduced to sums first, so a draw costs a row for each group, not for each member. A group's multiplicity in
    a draw is Poisson(1) by a hash of (seed, draw, group), which needs no coordination between tasks.
    """
    parts = []
    for m in preds:
        e = F.col(m) - F.col(y)
        parts.append(F.struct(F.lit(m).alias("model"), F.count(F.lit(1)).alias("k"), F.sum(e * e).alias("se"), F.sum(y).alias("sy"), F.sum(m).alias("sp"), F.sum(F.col(y) * F.col(y)).alias("syy"), F.sum(F.col(m) * F.col(m)).alias("spp"), F.sum(F.col(y) * F.col(m)).alias("syp")))
    sums = df.groupBy(group).agg(*[p.alias(f"_{i}") for i, p in enumerate(parts)]).select(group, F.explode(F.array(*[f"_{i}" for i in range(len(preds))])).alias("s")).select(group, "s.*")
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col(group).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    weight, acc, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        acc += term
        term /= k
        weight = weight + (u >= acc).cast("int")
    drawn = sums.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("w", weight).where("w > 0")
    t = drawn.groupBy("draw", "model").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("k", "se", "sy", "sp", "syy", "spp", "syp")])
    r = (F.col("k") * F.col("syp") - F.col("sy") * F.col("sp")) / F.sqrt((F.col("k") * F.col("syy") - F.col("sy") ** 2) * (F.col("k") * F.col("spp") - F.col("sp") ** 2))
    return t.select("draw", "model", F.col("k").alias("n"), F.sqrt(F.col("se") / F.col("k")).alias("rmse"), r.alias("r")).withColumn("composite", (F.col("rmse") + 1 - F.col("r")) / 2)


def bootstrap_summary(draws: DataFrame) -> DataFrame:
    return draws.groupBy("model").agg(F.stddev_pop("rmse").alias("se_rmse"), F.percentile("rmse", F.lit(0.025)).alias("rmse_low"), F.percentile("rmse", F.lit(0.975)).alias("rmse_high"), F.stddev_pop("r").alias("se_r"), F.stddev_pop("composite").alias("se_composite"))


def paired(draws: DataFrame, old: str, new: str) -> DataFrame:
    """Differences new - old over the same draws, with the share of draws that are better."""
    a, b = draws.where(F.col("model") == old).alias("a"), draws.where(F.col("model") == new).alias("b")
    d = a.join(b, "draw").select(*[(F.col(f"b.{c}") - F.col(f"a.{c}")).alias(c) for c in ("rmse", "r", "composite")])
    return d.agg(*[F.percentile(c, F.array(F.lit(0.025), F.lit(0.975))).alias(f"{c}_ci") for c in ("rmse", "r", "composite")], F.avg((F.col("rmse") < 0).cast("double")).alias("p_better_rmse"), F.avg((F.col("r") > 0).cast("double")).alias("p_better_r"), F.avg((F.col("composite") < 0).cast("double")).alias("p_better_composite"))
