"""Tables written on the way, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset on one machine (tests), a temporary one that is then set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not there.isDefined():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="terraloom-"))
        there = spark.sparkContext._jsc.sc().getCheckpointDir()
    return there.get()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet, read again: a short lineage that lost executors don't break, worked out once (a checkpoint works it out twice)."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
