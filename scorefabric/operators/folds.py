"""Fold assignment. Tables of groups by class are small next to the rows; folds come back as a DataFrame to join."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorefabric.operators.written import checkpointed


def _counts(df: DataFrame, group: str, stratum: str):
    rows = df.groupBy(group, stratum).count().orderBy(group, stratum).collect()
    groups, classes = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    at, col = {g: i for i, g in enumerate(groups)}, {c: i for i, c in enumerate(classes)}
    m = np.zeros((len(groups), len(classes)))
    for g, c, k in rows:
        m[at[g], col[c]] += k
    return groups, classes, m


def greedy_folds(counts: np.ndarray, k: int, seed: int, remap: bool = True) -> np.ndarray:
    """Fold of each group: groups in descending order of the population sd of their class counts, stable after a seeded
    shuffle, each to the fold that keeps the classes' shares most even; ties to the fold with fewest rows. Without remap
    the shuffled counts are read under the unshuffled group numbers, so balance is judged on the wrong groups."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(counts))
    shuffled = counts[order]
    by = np.argsort(-np.std(shuffled, axis=1), kind="stable")
    totals = np.maximum(counts.sum(0), 1)
    held, out = np.zeros((k, counts.shape[1])), np.zeros(len(counts), int)
    for i in by:
        best, key = 0, None
        for f in range(k):
            held[f] += shuffled[i]
            score = (float(np.std(held / totals, axis=0).mean()), float(held[f].sum() - shuffled[i].sum()))
            held[f] -= shuffled[i]
            if key is None or score < key:
                best, key = f, score
        held[best] += shuffled[i]
        out[order[i] if remap else i] = best
    return out


def dealt_folds(counts: np.ndarray, times: np.ndarray, k: int, seed: int) -> list[list[int]]:
    """greedy_folds over kinds of groups: counts has the class counts of a group of each kind, times how many groups have
    them. Every fold gets times // k groups of a kind; the folds of those left over, placed one by one, are returned."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(counts))
    by = order[np.argsort(-np.std(counts[order], axis=1), kind="stable")]
    totals = np.maximum((counts * times[:, None]).sum(0), 1)
    held, out, eye = np.zeros((k, counts.shape[1])), [[] for _ in counts], np.eye(k)[:, :, None]
    for i in by:
        held += counts[i] * (times[i] // k)
        for _ in range(times[i] % k):
            uneven = np.std((held + eye * counts[i]) / totals, axis=1).mean(1).round(12)
            best = int(np.lexsort((held.sum(1), uneven))[0])
            held[best] += counts[i]
            out[i].append(best)
    return out


def stratified_group_folds(df: DataFrame, group: str, stratum: str, k: int = 5, repeats: int = 1, seed: int = 42, remap: bool = True) -> DataFrame:
    """(group, repeat, fold): no group in two folds of a repeat, at any number of groups.

    Groups with the same class counts are one kind; the driver holds a row for each kind. Which groups of a kind go
    where follows from ranks by a hash, taken from salted counts. Without remap the driver holds every group.
    """
    spark = df.sparkSession
    kind = df.schema[group].dataType.simpleString()
    if not remap:
        groups, _, m = _counts(df, group, stratum)
        rows = [(g, r, int(f)) for r in range(repeats) for g, f in zip(groups, greedy_folds(m, k, seed + r, remap), strict=True)]
        return spark.createDataFrame(rows, f"{group} {kind}, repeat int, fold int")
    held = df.groupBy(group, stratum).count().groupBy(group).agg(F.to_json(F.sort_array(F.collect_list(F.array(F.coalesce(F.col(stratum).cast("string"), F.lit("")), F.col("count").cast("string"))))).alias("_v"))
    kinds = sorted(map(tuple, held.groupBy("_v").count().collect()))
    vectors = [json.loads(v) for v, _ in kinds]
    col = {c: i for i, c in enumerate(sorted({c for v in vectors for c, _ in v}))}
    m = np.zeros((len(kinds), len(col)))
    for i, v in enumerate(vectors):
        for c, n in v:
            m[i, col[c]] += int(n)
    times = np.array([n for _, n in kinds], int)
    left = [dealt_folds(m, times, k, seed + r) for r in range(repeats)]
    table = spark.createDataFrame([(v, i, [left[r][i] for r in range(repeats)]) for i, (v, _) in enumerate(kinds)], "_v string, _i int, _left array<array<int>>")
    each = held.join(table, "_v").select(group, "_i", F.posexplode("_left").alias("repeat", "_left"))
    h = F.md5(F.concat_ws(":", (F.lit(seed) + F.col("repeat")).cast("string"), F.col(group).cast("string")))
    s = each.withColumn("_h", h).withColumn("_s", F.substring("_h", 1, 2))
    before = s.groupBy("_i", "repeat", "_s").count().withColumn("_b", F.sum("count").over(Window.partitionBy("_i", "repeat").orderBy("_s")) - F.col("count")).drop("count")
    r = s.withColumn("_r", F.row_number().over(Window.partitionBy("_i", "repeat", "_s").orderBy("_h", group)) - 1).join(before, ["_i", "repeat", "_s"]).withColumn("_r", F.col("_b") + F.col("_r"))
    fold = F.when(F.col("_r") < F.size("_left"), F.get("_left", F.col("_r").cast("int"))).otherwise((F.col("_r") - F.size("_left")) % k)
    return r.select(group, "repeat", fold.cast("int").alias("fold"))


def hash_folds(df: DataFrame, group: str, k: int = 5, repeats: int = 1, seed: int = 42) -> DataFrame:
    """(group, repeat, fold) by md5 of (seed + repeat, group): no driver, any number of groups."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", (F.lit(seed) + F.col("repeat")).cast("string"), F.col(group).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.select(group).distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("fold", (h % k).cast("int"))


def stratified_folds(df: DataFrame, key: str, stratum: str, k: int = 5, seed: int = 42) -> DataFrame:
    """(key, fold) without groups: dealt in turn within each stratum by hash order; ranks come from salted counts, so a large stratum is many tasks."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    s = df.select(key, stratum, h.alias("_h"), F.substring(h, 1, 2).alias("_s"))
    before = s.groupBy(stratum, "_s").count().withColumn("_b", F.sum("count").over(Window.partitionBy(stratum).orderBy("_s")) - F.col("count")).drop("count")
    r = s.withColumn("_r", F.row_number().over(Window.partitionBy(stratum, "_s").orderBy("_h", key)) - 1)
    return r.join(before, [stratum, "_s"]).select(key, ((F.col("_b") + F.col("_r")) % k).cast("int").alias("fold"))


def crossed_strata(df: DataFrame, strata: list[str], out: str = "stratum", least: int = 5, rare: str = "rare") -> DataFrame:
    """Strata joined by "_" (nulls as empty); those of fewer than `least` rows become one. Counts are aggregated and joined back."""
    name = F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strata])
    named = df.withColumn(out, name)
    few = named.groupBy(out).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < least).drop("_n").withColumn("_rare", F.lit(rare))
    return named.join(few, out, "left").withColumn(out, F.coalesce("_rare", out)).drop("_rare")


def group_folds(sizes: dict, k: int = 4) -> dict:
    """Largest group to the lightest fold (inner folds of a model fit)."""
    load, out = [0] * k, {}
    for g, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        f = min(range(k), key=lambda i: (load[i], i))
        out[g], load[f] = f, load[f] + n
    return out


def lpt_shards(df: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """(key, shard): rows in descending order of size dealt in turn, null sizes last; equal sizes follow one another.

    Equal sizes share an average rank; within it rows are numbered from counts of a hash of the key, so no size is one task.
    """
    from scorefabric.operators.stats import ranks_by_count

    sized = df.select(key, F.coalesce(-F.col(size).cast("double"), F.lit(float("inf"))).alias("_s"))
    ranked = ranks_by_count(sized, "_s", "_r").withColumn("_h", F.pmod(F.xxhash64(key), F.lit(64)))
    own = Window.partitionBy("_r")
    counts = ranked.groupBy("_r", "_h").count().withColumns({"_b": F.sum("count").over(own.orderBy("_h")) - F.col("count"), "_n": F.sum("count").over(own)}).drop("count")
    row = F.row_number().over(Window.partitionBy("_r", "_h").orderBy(key)) - 1
    placed = ranked.withColumn("_i", row).join(counts, ["_r", "_h"])
    at = F.round(F.col("_r") - (F.col("_n") - 1) / 2 - 1).cast("long") + F.col("_b") + F.col("_i")
    return placed.select(key, F.pmod(at, F.lit(n)).cast("int").alias("shard"))


def sampled(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each group, by hash order."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def numbered(df: DataFrame, key: str, out: str) -> DataFrame:
    """df with row numbers from 0 in the order of key: ranges are numbered within, then shifted by the sizes of those before."""
    placed = checkpointed(df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id()))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = sizes.withColumn("_b", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1
    return placed.withColumn("_i", inside).join(F.broadcast(before), "_p").withColumn(out, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


#: A prime, and the bit that decides: bits of x * a + b modulo the prime.
PRIME, BIT = (1 << 31) - 1, 15


def round_keys(seed: int, rounds: int) -> list[tuple[int, int, int]]:
    rng = np.random.default_rng(seed)
    return [(int(rng.integers(0, 1 << 62)), int(rng.integers(1, PRIME)), int(rng.integers(0, PRIME))) for _ in range(rounds)]


def permuted(index: Column, n: int, seed: int = 42, rounds: int = 24) -> Column:
    """A keyed bijection of 0 .. n - 1, for any n: a seeded shuffle without a sort; places below k are a choice of k rows.

    Each round pairs x with (key - x) mod n and swaps the two or not, by a bit that depends on the pair alone, so a round
    undoes itself and no place is met twice.
    """
    keys = F.array(*[F.struct(F.lit(a % max(n, 1)).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(c).cast("long").alias("c")) for a, b, c in round_keys(seed, rounds)])

    def step(x: Column, k: Column) -> Column:
        other = (k["a"] + n - x) % n
        bit = F.shiftright((F.greatest(x, other) % PRIME * k["b"] + k["c"]) % PRIME, BIT).bitwiseAND(F.lit(1).cast("long"))
        return F.when(bit == 1, other).otherwise(x)

    return F.aggregate(keys, index.cast("long"), step)
