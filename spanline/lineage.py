"""Cutting the lineage of loops in the cluster's shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> str:
    """The shared folder of the session's own setting; only a session in one process may do without, and gets a local one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="spanline-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    ready(df.sparkSession)
    return df.checkpoint()
