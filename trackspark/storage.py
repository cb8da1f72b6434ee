"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    _made.append(f"{base.rstrip('/')}/trackspark-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """df written as Parquet in a shared folder and read back: computed once, and not lost with an executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> None:
    """Delete the intermediate tables of this process; call it once results are written."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())  # type: ignore[union-attr]
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
