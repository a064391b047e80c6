"""Event-time windows, for batch tables and for streams alike: give a streaming DataFrame with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, ts: str, size: str, by: list[str], value: str) -> DataFrame:
    out = df.groupBy(F.window(ts, size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(*by, F.col("w.start").alias("start"), "n", "total")


def sliding(df: DataFrame, ts: str, size: str, slide: str, by: list[str], value: str) -> DataFrame:
    out = df.groupBy(F.window(ts, size, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(*by, F.col("w.start").alias("start"), "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, by: list[str], value: str) -> DataFrame:
    """Sessions end where a gap exceeds `gap` (events exactly a gap apart stay together)."""
    out = df.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(*by, F.col("w.start").alias("start"), "n", "total")


def follow(stream: DataFrame, ts: str, late: str, gap: str, by: list[str], value: str, path: str, checkpoint: str):
    """Append finished sessions of a stream to a Parquet folder, once each."""
    out = sessions(stream.withWatermark(ts, late), ts, gap, by, value)
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
