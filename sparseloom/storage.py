"""Tables in the folder that driver and executors share, where long plans are cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A new path below spark.checkpoint.dir.

    Where that is unset a local session, as in tests, gets a temporary folder; a cluster
    gets an error, as its executors would not see the driver's folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Have the driver remove a path, which is there by now, when it ends."""
    files, place = _file_system(spark, path)
    files.deleteOnExit(place)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a path that this library has written; nothing happens where it is gone."""
    files, place = _file_system(spark, path)
    files.delete(place, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names within a folder; none if there is no such folder."""
    files, place = _file_system(spark, path)
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A shared path for what no one needs once the driver has ended: it is removed then (what is not there yet could not be put down for that, so the folder around it is made now)."""
    path = shared_path(spark, purpose)
    files, place = _file_system(spark, path)
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{path}/at"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write df and read it again: what follows starts from files, so its plan stays short and a lost executor costs one step. The files go when the driver ends."""
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
