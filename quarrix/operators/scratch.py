"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder serves, but only under a
    ``local`` master: on a cluster a machine-local folder would lose data.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="quarrix-")
    spark.sparkContext.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/quarrix/{uuid.uuid4().hex}-{label}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back.

    Cuts the lineage: what follows survives lost executors without repeating
    what came before, and sees one fixed order of non-deterministic results.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def kept(df: DataFrame, label: str) -> DataFrame:
    """As ``staged``; where a cluster names no shared folder, on the executors' disks, lost with an executor.

    The shuffles that made the table may go at once.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    found = staged(df, label) if shared else df.localCheckpoint(storageLevel=StorageLevel.DISK_ONLY)
    spark._jvm.System.gc()
    return found


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``staged`` that nothing reads any more, then lets Spark clear the shuffles of finished jobs.

    Shuffle files go only when the driver's JVM has found their plans to be
    garbage; without the call they would stay until its heap happens to fill.
    """
    for table in tables:
        spark = table.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if tables:
        spark._jvm.System.gc()
