"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings the plans in this package rely on.  Skewed joins are split at run time, also where
#: the split costs one more exchange; text sorts by bytes; days and hours are those of UTC.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

_CHECKPOINT = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Apply SETTINGS to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def working_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder name for written intermediate tables, below the cluster's shared folder.

    The shared folder is the session's checkpoint directory.  Only a local session without that
    setting falls back to a folder of this machine; a cluster without it is an error, because
    other machines could not read what one of them writes there.
    """
    root = spark.conf.get(_CHECKPOINT, None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {_CHECKPOINT} to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="hashloom-")
        spark.conf.set(_CHECKPOINT, root)
    return f"{qualified(spark, root).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path and the path as its object."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme that Spark itself reads and writes it by, so that tasks that open files
    themselves go to the same store.  Only paths of the local scheme stand for the disk of a machine."""
    system, place = file_system(spark, path)
    return system.makeQualified(place).toString()


def discard(spark: SparkSession, path: str) -> None:
    """Remove an intermediate folder that no frame reads any more."""
    system, place = file_system(spark, path)
    system.delete(place, True)


def written(frame, purpose: str):
    """Write a frame to the shared folder and return the frame that reads it back.

    Used where a result is read more than once or is expensive to recompute after a lost
    executor: the plan behind the returned frame is a scan.
    """
    spark = frame.sparkSession
    path = working_folder(spark, purpose)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
