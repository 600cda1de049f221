"""Intermediate results that are read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def kept(df: DataFrame) -> DataFrame:
    """df, written once to the folder of spark.checkpoint.dir, which all executors share; kept twice it is written once.

    Where that is unset, a local session gets a folder of this machine; on a cluster it is an error.
    """
    if getattr(df, "kept_", False):
        return df
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="spark-"))
    out = df.checkpoint(eager=True)
    out.kept_ = True
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a stored table in the same shared folder; what lies there goes when the session's file system closes."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
