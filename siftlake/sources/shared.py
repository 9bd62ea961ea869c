"""Intermediate tables in the folder that every node sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where that is unset on one machine (tests), a folder of its own; on a cluster it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that every node sees")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siftlake-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_dir(spark: SparkSession, name: str = "work") -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """Write and read again: what is used several times is computed once, and later jobs start here, whatever executors are lost."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
