"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where none is set, a temporary one of this machine, on a local
    master only; on a cluster that would lose what other machines write, so it fails there."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df in the shared folder and reads it again: the lineage of a loop ends there, and a lost
    executor loses nothing of it.  clear_stored() removes what was written."""
    folder = f"{shared_folder(df.sparkSession)}/quarrylane-{uuid.uuid4().hex}"
    _made.append(folder)
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def clear_stored(spark: SparkSession) -> int:
    """Deletes the tables that stored() wrote from this driver, to be called when all results that read them
    have been written; returns their number."""
    n = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
