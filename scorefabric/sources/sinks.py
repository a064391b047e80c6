"""Sinks: Spark's committers write; contracts are checked before a submission goes out."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorefabric.operators.contracts import duplicates, not_finite, require, uncovered


def to_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def to_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def packed_halves(df: DataFrame, columns: list[str]) -> DataFrame:
    """Arrays of numbers as the bytes of 16-bit floats, little-endian: half of what 32-bit floats take; null arrays stay null, null elements become NaN."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name in columns else f for f in df.schema])

    def pack(batches):
        for b in batches:
            out = []
            for name, column in zip(b.schema.names, b.columns, strict=True):
                if name in columns:
                    with np.errstate(over="ignore"):  # beyond 65504 is infinite
                        cells = [None if v is None else np.array([np.nan if e is None else e for e in v], np.float64).astype("<f2").tobytes() for v in column.to_pylist()]
                    column = pa.array(cells, pa.binary())
                out.append(column)
            yield pa.RecordBatch.from_arrays(out, b.schema.names)

    return df.mapInArrow(pack, schema)


def unpacked_halves(df: DataFrame, columns: list[str]) -> DataFrame:
    """packed_halves read back, as 32-bit floats."""
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.FloatType())) if f.name in columns else f for f in df.schema])

    def unpack(batches):
        for b in batches:
            out = []
            for name, column in zip(b.schema.names, b.columns, strict=True):
                if name in columns:
                    column = pa.array([None if v is None else np.frombuffer(v, "<f2").astype(np.float32) for v in column.to_pylist()], pa.list_(pa.float32()))
                out.append(column)
            yield pa.RecordBatch.from_arrays(out, b.schema.names)

    return df.mapInArrow(unpack, schema)


def to_arrays(df: DataFrame, path: str, by: tuple[str, ...] = ("encoder", "layer"), halves: tuple[str, ...] = ()) -> None:
    """Vectors in long form, partitioned so that a band of layers is a pruned scan; those named in `halves` are stored as 16-bit floats (see unpacked_halves)."""
    df = packed_halves(df, list(halves)) if halves else df
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*[c for c in by if c in df.columns]).parquet(path)


def resumed(spark: SparkSession, source: str, schema: str, compute: Callable[[DataFrame], DataFrame], out: str, progress: str, files: int = 1) -> None:
    """Partial results that survive a failure: `compute` runs over `files` files of a Parquet folder at a time, each batch is
    committed with what it wrote, and the call returns when all are done.

    Called again after a failure, or after new files, it goes on with the files that `progress` has no commit for. Batches
    that failed half-way leave files that no commit names; spark.read does not list them, so a rerun leaves
    neither gaps nor doubles. compute sees each row once and joins no rows of other batches.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    query = compute(stream).writeStream.format("parquet").option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()


def to_report(df: DataFrame, limit: int = 10_000) -> str:
    """A small report as JSON text."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError("not a report: too many rows")
    return json.dumps([r.asDict(recursive=True) for r in rows], default=str)


def submission(df: DataFrame, expected: DataFrame, key: str, label: str, path: str) -> None:
    """Unique keys, the expected ones, finite labels in {0} or [1, 5]."""
    require(duplicates(df, [key]), "keys repeat")
    require(uncovered(df, expected, [key]), "keys differ from the expected ones")
    require(not_finite(df, [label]), "labels are missing")
    require(df.where((F.col(label) != 0) & ~F.col(label).between(1, 5)), "labels out of range")
    to_csv(df.select(key, label), path, single=True)
