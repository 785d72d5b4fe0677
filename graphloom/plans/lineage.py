"""Cutting lineage through a table in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, as in tests, a folder of our own, on one machine only."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            path = current.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            path = tempfile.mkdtemp(prefix="graphloom-")
        else:
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str = "level") -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
