"""Where intermediate results go: the shared folder that the cluster names."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tallyloom-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local folder only in local mode and where it is unset."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{_local_folder()}"


def place(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def temporary(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    found, fs = place(spark, path)
    fs.deleteOnExit(found)
    return path


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write to a new table in the shared folder and read it back: smaller than a checkpoint, and columns prune.

    The shuffle files of plans that have ended go first; else they stay until the driver happens to collect its garbage.
    by: a column of few values, each of which gets files of its own.
    """
    spark = df.sparkSession
    path = temporary(spark, name)
    gc.collect()
    spark._jvm.System.gc()
    writers, before = "spark.sql.maxConcurrentOutputFileWriters", None
    if by:  # a file for each value side by side, else all rows are sorted
        before = spark.conf.get(writers)
        spark.conf.set(writers, "8")
    try:
        df.write.option("compression", "zstd").partitionBy(*[by] * bool(by)).parquet(path)
    finally:
        if by:
            spark.conf.set(writers, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
