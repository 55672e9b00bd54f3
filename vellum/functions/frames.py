"""Cutting lineage in iterative plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoints(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (as in tests on one machine) one is made, on a cluster that is an error."""
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            where = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.sparkContext.setCheckpointDir(where)
    return context.getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """The rows, checkpointed in the session's spark.checkpoint.dir."""
    checkpoints(df.sparkSession)
    return df.checkpoint()
