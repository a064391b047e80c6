"""Contributions of features to the predictions of tree ensembles: exact Shapley values of each path."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A leaf: (value, {feature: (low, high, share)}): rows in (low, high] of all its features reach it; `share` is the part of
# the rows that a feature's splits on the path let through.
Leaf = tuple[float, dict[int, tuple[float, float, float]]]


def leaves(node: dict, weight: float = 1.0) -> list[Leaf]:
    """Leaves of a nested tree: inner nodes {feature, threshold, left, right, cover}, leaves {value, cover}; left is <= threshold."""
    out: list[Leaf] = []
    todo = [(node, {})]
    while todo:
        at, path = todo.pop()
        if "value" in at:
            out.append((weight * at["value"], path))
            continue
        f, cut = at["feature"], at["threshold"]
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        for side, bounds in (("left", (low, min(high, cut))), ("right", (max(low, cut), high))):
            child = at[side]
            todo.append((child, {**path, f: (*bounds, share * child["cover"] / at["cover"])}))
    return out


def fitted_leaves(model) -> list[Leaf]:
    """Leaves of a fitted Spark tree ensemble with continuous splits."""

    def nested(n) -> dict:
        cover = float(n.impurityStats().count())
        if n.getClass().getSimpleName() != "InternalNode":
            return {"value": n.prediction(), "cover": cover}
        return {"feature": n.split().featureIndex(), "threshold": n.split().threshold(), "left": nested(n.leftChild()), "right": nested(n.rightChild()), "cover": cover}

    return [x for t, w in zip(model.trees, model.treeWeights, strict=True) for x in leaves(nested(t._java_obj.rootNode()), w)]


def expected(paths: list[Leaf]) -> float:
    """The prediction with no feature known."""
    return sum(v * math.prod(s for _, _, s in p.values()) for v, p in paths)


def shapley(x: np.ndarray, paths: list[Leaf]) -> np.ndarray:
    """(rows, features): a row's values and `expected` add up to its prediction. Work doubles with each feature of a path."""
    out = np.zeros(x.shape)
    for value, path in paths:
        names, m = list(path), len(path)
        inside = np.column_stack([(x[:, f] > path[f][0]) & (x[:, f] <= path[f][1]) for f in names]).astype(float) if m else None
        share = np.array([path[f][2] for f in names])
        for j in range(m):
            # by[k]: the sum over sets of k other features, known ones by their test, the others by their share
            by = [np.ones(len(x))]
            for i in range(m):
                if i != j:
                    by = [(by[k] * share[i] if k < len(by) else 0) + (by[k - 1] * inside[:, i] if k else 0) for k in range(len(by) + 1)]
            weight = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
            out[:, names[j]] += value * (inside[:, j] - share[j]) * sum(w * b for w, b in zip(weight, by, strict=True))
    return out


def contributions(df: DataFrame, paths: list[Leaf], key: list[str], features: list[str]) -> DataFrame:
    """(key, feature, x, contribution) of every row and feature; map only. A null or NaN feature passes no split of its own."""
    base = df.select(*key, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    cols = [f"_x{i}" for i in range(len(features))]

    def run(batches):
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float)
            yield pd.DataFrame({**{k: pdf[k] for k in key}, "_xs": list(x), "_cs": list(shapley(x, paths))})

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    rows = base.mapInPandas(run, f"{kinds}, _xs array<double>, _cs array<double>")
    names = F.array(*[F.lit(f) for f in features])
    return rows.select(*key, F.explode(F.arrays_zip(names.alias("feature"), F.col("_xs").alias("x"), F.col("_cs").alias("contribution"))).alias("r")).select(*key, "r.feature", "r.x", "r.contribution")


def importance(parts: DataFrame) -> DataFrame:
    """(feature, strength, sign): mean absolute contribution, and whether it rises (1) or falls (-1) with the feature by ranks."""
    from scorefabric.operators.stats import ranks_by_count

    known = parts.where("x is not null and not isnan(x)")
    ranked = ranks_by_count(ranks_by_count(known, "x", "_a", ["feature"]), "contribution", "_b", ["feature"])
    sign = ranked.groupBy("feature").agg(F.signum(F.corr("_a", "_b")).alias("sign"))
    return parts.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("strength")).join(sign, "feature", "left")
