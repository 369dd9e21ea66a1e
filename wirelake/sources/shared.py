"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in spark.checkpoint.dir. A local folder is made only where that is not set and Spark runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = tempfile.mkdtemp(prefix="wirelake-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/{what}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    fresh_path(df.sparkSession, "checkpoint")  # where none is named, it names one
    return df.checkpoint()
