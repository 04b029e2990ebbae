"""Cutting lineage through the shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="signalmill-")


def materialize(df: DataFrame) -> DataFrame:
    """The rows, written once by a reliable checkpoint, so that a lost executor
    costs nothing that was done before. The folder is the session's
    ``spark.checkpoint.dir``; only a local session without one, as in tests, gets
    a temporary folder of this machine."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
