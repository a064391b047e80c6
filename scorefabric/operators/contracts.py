"""Contracts on tables: each returns the rows that break it; `require` raises where there are any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorefabric.operators.quantiles import quantiles


class ContractError(AssertionError):
    pass


def require(broken: DataFrame, what: str) -> None:
    found = broken.take(3)
    if found:
        raise ContractError(f"{what}: {found}")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).count().where("count > 1")


def uncovered(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys of one side only."""
    x, y = a.select(*key).distinct(), b.select(*key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("a")).union(y.join(x, key, "left_anti").withColumn("side", F.lit("b")))


def not_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    bad = [F.col(c).isNull() | F.isnan(c) | F.abs(c).isin(float("inf")) for c in columns]
    return df.where(reduce(lambda a, b: a | b, bad))


def unequal(df: DataFrame, a: str, b: str, rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    return df.where(~(F.abs(F.col(a) - F.col(b)) <= atol + rtol * F.abs(b)))


def groups_across(df: DataFrame, group: str, fold: str) -> DataFrame:
    return df.groupBy(group).agg(F.countDistinct(fold).alias("folds")).where("folds > 1")


def miscounted(oof: DataFrame, key: list[str], repeats: int) -> DataFrame:
    return oof.groupBy(*key).count().where(F.col("count") != repeats)


def join_one_to_one(a: DataFrame, b: DataFrame, key: list[str], suffixes: tuple[str, str] = ("_old", "_new")) -> DataFrame:
    """Inner join that demands unique keys on both sides and the same keys."""
    require(duplicates(a, key), "keys repeat on the left")
    require(duplicates(b, key), "keys repeat on the right")
    require(uncovered(a, b, key), "keys of one side only")
    same = (set(a.columns) & set(b.columns)) - set(key)
    for c in same:
        a, b = a.withColumnRenamed(c, c + suffixes[0]), b.withColumnRenamed(c, c + suffixes[1])
    return a.join(b, key)


def aligned(canonical: DataFrame, artifact: DataFrame, key: list[str]) -> DataFrame:
    """An artifact's columns for every canonical row: its keys must be unique and miss no canonical row; rows of the
    artifact beyond the canonical ones go."""
    require(duplicates(artifact, key), "keys repeat in the artifact")
    require(canonical.join(artifact.select(*key), key, "left_anti"), "rows that the artifact lacks")
    return canonical.join(artifact.drop(*[c for c in artifact.columns if c in canonical.columns and c not in key]), key)


def scattered(rows: DataFrame, predictions: DataFrame, key: list[str], value: str, default: float = 0.0) -> DataFrame:
    """Every row with its prediction, or the default where it has none."""
    return rows.join(predictions.select(*key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(float(default))))


def join_features(base: DataFrame, parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Left joins of feature parts, one after another, on one key: all exchanges share its partitioning."""
    return reduce(lambda x, y: x.join(y, key, "left"), parts, base)


def fill_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and NULL to exact column medians over all rows, those of all columns found together."""
    clean = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})
    long = clean.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("e.*")
    medians = {r["c"]: r["q"][0] for r in quantiles(long, "x", [0.5], ["c"]).collect()}  # a row a column
    return clean.na.fill(medians) if medians else clean


def zscore(df: DataFrame, columns: list[str], least: float = 1e-8) -> DataFrame:
    """Population z-scores over all rows; columns without spread are only centred."""
    s = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return df.withColumns({c: (F.col(c) - s[f"m_{c}"]) / (s[f"s_{c}"] if s[f"s_{c}"] and s[f"s_{c}"] > least else 1.0) for c in columns})
