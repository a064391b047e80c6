"""Bootstrap of groups with a fixed number of draws: every draw takes as many groups, with replacement, as there are.

Groups are reduced to sums and dealt over blocks. How many of a draw's groups fall to a block follows from binomials
down a tree over the blocks, each seeded by its place, so every block's task finds its own share without asking others;
within the block groups are picked at random. A task multiplies the multiplicities of all draws with its groups' sums and
sends on a row for each draw.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of a block, about; multiplicities that a task holds at once.
BLOCK, CELLS = 4096, 1 << 22


def shares(sizes: list[int], block: int, draws: int, seed: int) -> np.ndarray:
    """How many groups of each draw fall to a block: over all blocks they add up to sum(sizes), in every draw."""
    before = np.r_[0, np.cumsum(sizes)]
    low, high, out = 0, len(sizes), np.full(draws, before[-1])
    while high - low > 1:
        mid = (low + high) // 2
        left = np.random.default_rng([seed, low, high]).binomial(out, (before[mid] - before[low]) / (before[high] - before[low]) if before[high] > before[low] else 0.0)
        low, high, out = (low, mid, left) if block < mid else (mid, high, out - left)
    return out


def multiplicities(sizes: list[int], block: int, draws: int, seed: int):
    """(first draw, how often each group of the block occurs in it and the following ones), a part of the draws at a time."""
    k, taken = sizes[block], shares(sizes, block, draws, seed)
    rng = np.random.default_rng([seed, block, len(sizes), 1])
    step = max(1, CELLS // max(k, 1))
    for start in range(0, draws, step):
        some = taken[start : start + step]
        picks = rng.integers(0, k, some.sum()) if k else np.zeros(0, np.int64)
        yield start, np.bincount(np.repeat(np.arange(len(some)), some) * k + picks, minlength=len(some) * k).reshape(len(some), k)


def dealt(df: DataFrame, group: str, block: int = BLOCK) -> tuple[DataFrame, list[int]]:
    """df, a row for each group, with the group's block, and the number of groups of each block."""
    blocks = max(1, math.ceil(df.count() / block))
    placed = df.withColumn("_block", F.pmod(F.xxhash64(group), F.lit(blocks)).cast("int"))
    sizes = [0] * blocks
    for b, n in placed.groupBy("_block").count().collect():  # a row for some thousands of groups
        sizes[b] = n
    return placed, sizes


def bootstrap(df: DataFrame, group: str, y: str, preds: list[str], n: int = 1000, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """Metrics of n draws of groups: (draw, model, n, rmse, r, composite); all models have the same draws.

    Rows with a null or NaN label or prediction are left out; null groups are one group; no rows, no result.
    """
    clean = df.select(group, *[F.col(c).cast("double").alias(c) for c in [y, *preds]])
    for c in [y, *preds]:
        clean = clean.where(F.col(c).isNotNull() & ~F.isnan(c))
    of = {"k": F.count(F.lit(1)).cast("double"), "sy": F.sum(y), "syy": F.sum(F.col(y) * F.col(y))}
    for i, m in enumerate(preds):
        of |= {f"se{i}": F.sum((F.col(m) - F.col(y)) * (F.col(m) - F.col(y))), f"sp{i}": F.sum(m), f"spp{i}": F.sum(F.col(m) * F.col(m)), f"syp{i}": F.sum(F.col(y) * F.col(m))}
    sums, sizes = dealt(clean.groupBy(group).agg(*[c.alias(name) for name, c in of.items()]), group, block)
    names = list(of)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(group)
        s = pdf[names].to_numpy(float)
        parts = [(start + np.arange(len(w)), w @ s) for start, w in multiplicities(sizes, int(pdf["_block"].iloc[0]), n, seed)]
        return pd.DataFrame(np.concatenate([x for _, x in parts]), columns=names).assign(draw=np.concatenate([d for d, _ in parts]))

    t = sums.groupBy("_block").applyInPandas(draw, ", ".join(f"{c} double" for c in names) + ", draw int").groupBy("draw").agg(*[F.sum(c).alias(c) for c in names])
    c = F.col
    each = []
    for i, m in enumerate(preds):
        r = (c("k") * c(f"syp{i}") - c("sy") * c(f"sp{i}")) / F.sqrt((c("k") * c("syy") - c("sy") ** 2) * (c("k") * c(f"spp{i}") - c(f"sp{i}") ** 2))
        each.append(F.struct(F.lit(m).alias("model"), c("k").cast("long").alias("n"), F.sqrt(c(f"se{i}") / c("k")).alias("rmse"), r.alias("r")))
    return t.select("draw", F.explode(F.array(*each)).alias("m")).select("draw", "m.*").withColumn("composite", (c("rmse") + 1 - c("r")) / 2)
