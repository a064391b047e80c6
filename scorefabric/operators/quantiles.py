"""Exact quantiles by refining ranges, without bringing a table's values to one task.

A mergeable sketch gives a grid of values for each group, and a target's two ranks lie between two values of the grid. One
aggregate then counts the rows below that range and each different value inside it. Where a range may hold too many values
it is refined by a grid of its own rows, each time to some hundredth part, before it is counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorefabric.operators.written import checkpointed

#: Steps of a grid, and values of a range up to which they are sorted in one task.
GRID, MOST = 1000, 1 << 20


def _grid(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _n, _grid): rows and GRID + 1 values from least to greatest; the sketch errs by a twentieth of a step at most."""
    at = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
    known = F.when(F.isnan("_x"), float("inf")).otherwise(F.col("_x"))  # a sketch has no order for NaN
    return rows.groupBy(*keys).agg(F.count("_x").alias("_n"), F.percentile_approx(known, at, F.lit(20 * GRID)).alias("_grid"))


def _ranged(targets: DataFrame) -> DataFrame:
    """Targets (_low, _high: ranks from 0 among _n rows) with a range that holds both ranks: a step of the grid is spare on each side."""
    step = lambda rank: rank / F.col("_n") * GRID
    first = F.greatest(F.floor(step(F.col("_low"))) - 1, F.lit(0)).cast("int")
    last = F.least(F.ceil(step(F.col("_high") + 1)) + 1, F.lit(GRID)).cast("int")
    return targets.withColumns({"_from": F.get("_grid", first), "_to": F.get("_grid", last)}).drop("_grid")


def _width(n: int) -> float:
    """Rows that a range holds besides those equal to its ends."""
    return 5 * n / GRID + 5


def quantiles(df: DataFrame, value: str, probabilities: list[float], by: list[str] | None = None, most: int = MOST) -> DataFrame:
    """(by, n, q): the number of rows with a value, and exact quantiles, interpolated between neighbours, as an array.

    Nulls are left out and a group of nulls has no row; NaN is the greatest value; an empty table gives an empty result.
    """
    by = by or []
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    if not by:
        rows = rows.withColumn("_all", F.lit(0))
    keys = by or ["_all"]
    same = lambda a, b, names: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names]
    place = F.col("_p") * (F.col("_n") - 1)
    targets = _grid(rows, keys).withColumn("_t", F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(float(p)).alias("_p")) for i, p in enumerate(probabilities)]))).select("*", "_t.*").drop("_t")
    targets = targets.withColumns({"_all_n": F.col("_n"), "_at": place, "_low": F.floor(place), "_high": F.ceil(place), "_below": F.lit(0).cast("long")})
    targets = checkpointed(_ranged(targets))  # groups times probabilities rows
    wide = targets.agg(F.max("_n")).first()[0] or 0
    some = rows
    while _width(wide) > most:
        # one more grid for each target, of the rows in its range
        inside, below = _split(some, targets, keys, same)
        counted = below.join(_grid(inside.select(*keys, "_i", "_x"), [*keys, "_i"]).alias("g"), [*same("t", "g", keys), F.col("t._i") == F.col("g._i")])
        moved = counted.select(*[F.col(f"t.{k}").alias(k) for k in keys], *[F.col(f"t.{c}").alias(c) for c in ("_i", "_p", "_all_n", "_at")], (F.col("t._low") - F.col("_less")).alias("_low"), (F.col("t._high") - F.col("_less")).alias("_high"), (F.col("t._below") + F.col("_less")).alias("_below"), F.col("g._n").alias("_n"), F.col("g._grid").alias("_grid"))
        before, targets = wide, checkpointed(_ranged(moved))
        some = checkpointed(inside.select(*keys, "_i", "_x"))
        # values equal to an end stay inside, however often they occur: they are one value when counted
        wide = targets.where("_from < _to").agg(F.max("_n")).first()[0] or 0
        if wide >= before:
            break
    return _picked(some, targets, by, keys, same)


def _matched(rows: DataFrame, targets: DataFrame, keys: list[str], same) -> DataFrame:
    """Each row with the targets of its group whose range does not end below it."""
    on = [*same("r", "t", keys), (F.col("r._x") <= F.col("t._to")) | (F.col("t._to") == float("inf"))]
    if "_i" in rows.columns:
        on.append(F.col("r._i") == F.col("t._i"))
    return rows.alias("r").join(targets.alias("t"), on)


def _split(rows: DataFrame, targets: DataFrame, keys: list[str], same) -> tuple[DataFrame, DataFrame]:
    """The rows inside each target's range, and the targets (alias t) with the number of rows below it."""
    both = _matched(rows, targets, keys, same).select(*[F.col(f"t.{k}").alias(k) for k in keys], F.col("t._i").alias("_i"), F.col("r._x").alias("_x"), F.col("t._from").alias("_from"))
    less = both.groupBy(*keys, "_i").agg(F.count_if(F.col("_x") < F.col("_from")).alias("_less"))
    below = targets.alias("t").join(less.alias("l"), [*same("t", "l", keys), F.col("t._i") == F.col("l._i")]).select("t.*", "l._less").alias("t")
    return both.where(F.col("_x") >= F.col("_from")), below


def _picked(rows: DataFrame, targets: DataFrame, by: list[str], keys: list[str], same) -> DataFrame:
    """Counts the values of each range, those below it as one, and reads off the values at the two ranks."""
    carried = ["_i", "_all_n", "_at", "_low", "_high", "_below"]
    value = F.when(F.col("r._x") >= F.col("t._from"), F.col("r._x"))
    counts = _matched(rows, targets, keys, same).groupBy(*[F.col(f"t.{k}").alias(k) for k in keys], *[F.col(f"t.{c}").alias(c) for c in carried], value.alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    run = F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_x")).rowsBetween(Window.unboundedPreceding, 0))
    at = lambda rank: F.min(F.when((F.col("_run") > F.col(rank)) & F.col("_x").isNotNull(), F.col("_x")))
    low = counts.withColumn("_run", run).groupBy(*keys, *carried).agg(at("_low").alias("_v"), at("_high").alias("_w"), F.max("_run").alias("_seen"), F.max(F.when(F.col("_x").isNull(), F.col("_run"))).alias("_under"))
    held = (F.col("_seen") > F.col("_high")) & (F.coalesce("_under", F.lit(0)) <= F.col("_low"))
    rank = F.col("_at") - F.col("_below")
    q = F.when(~held, F.raise_error(F.lit("a range does not hold its ranks"))).when((F.col("_low") == F.col("_high")) | (F.col("_v") == F.col("_w")), F.col("_v")).otherwise((F.col("_high") - rank) * F.col("_v") + (rank - F.col("_low")) * F.col("_w"))
    each = low.select(*keys, "_all_n", F.struct("_i", q.cast("double").alias("q")).alias("_q"))
    out = each.groupBy(*keys, "_all_n").agg(F.transform(F.array_sort(F.collect_list("_q")), lambda e: e["q"]).alias("q"))  # an entry a probability
    return out.select(*by, F.col("_all_n").alias("n"), "q")
