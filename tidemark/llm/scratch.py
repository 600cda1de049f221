"""Intermediate results that every executor can read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Where that is unset, a local session (a test) gets a folder of this machine; on a cluster it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read back: it cuts lineage and survives lost executors.

    The files go with `free`, at the latest when the driver's file system is closed.
    """
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at, files = _place(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def free(*frames: DataFrame) -> None:
    """Deletes the files of stored frames; what was stored from them stays."""
    for df in frames:
        if path := getattr(df, "stored_at", None):
            at, files = _place(df.sparkSession, path)
            files.delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """A small df, checkpointed eagerly to the shared folder."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)
