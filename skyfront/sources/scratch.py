"""Where intermediate tables go: the folder that the session names in ``spark.checkpoint.dir``,
which the driver and all executors see. Only a local session may go without one: its driver
and executor are one process, so a folder of our own is made, once for the session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if getattr(spark, "_scratch_root", None) is None:
        spark._scratch_root = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return spark._scratch_root


def at(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder's path; whatever is written there goes when the driver's JVM ends."""
    path = f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    p, files = at(spark, path)
    files.mkdirs(p)
    files.deleteOnExit(p)
    return path


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read again, and its path.

    Cuts the lineage: a lost executor costs no more than the tasks it was running. What is not
    :func:`dropped` before goes when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("append").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that nothing reads any more."""
    for path in paths:
        p, files = at(spark, path)
        files.delete(p, True)
        files.cancelDeleteOnExit(p)
