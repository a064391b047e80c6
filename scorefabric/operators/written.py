"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the session's checkpoint folder."""
    _ready(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, at: str) -> DataFrame:
    """df written to a path, over what was there, and read back. Where a loop joins its own results this ends the growth of
    plan statistics: a checkpoint keeps its estimated size, and a join's estimate is the product of its sides'."""
    df.write.mode("overwrite").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    _ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _ready(spark: SparkSession) -> None:
    """Set the checkpoint folder from spark.checkpoint.dir; a temporary one only where none is set and all is one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
            at = tempfile.mkdtemp(prefix="scorefabric-")
        context.setCheckpointDir(at)
