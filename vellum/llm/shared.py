"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset (as in tests on one machine), a temporary folder is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = got.get() if got.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.sparkContext.setCheckpointDir(where)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(where)
    return where


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver ends."""
    path = f"{folder(spark).rstrip('/')}/vellum-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def prefix(df: DataFrame) -> str:
    """What no column's name begins with, for columns that are only there in between."""
    own = "__"
    while any(c.lower().startswith(own) for c in df.columns):
        own += "_"
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends here, and a lost executor takes nothing with it."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session may have ended already
            return
