"""Lineage cuts in the folder that all machines share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share (spark.checkpoint.dir); an own one where none is set and one machine does all."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    known = context._jsc.sc().getCheckpointDir()
    if found:
        if known.isEmpty():
            context.setCheckpointDir(found)
        return found
    if known.isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get()


def cut(df: DataFrame) -> DataFrame:
    """Computes df once, into the shared folder; later uses read that, also after an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
