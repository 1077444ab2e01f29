"""The folder that the driver and all executors see, for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def _own_dir() -> str:
    made = tempfile.mkdtemp(prefix="tallyforge-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where it is unset and the session runs in one process a new local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        set_by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not set_by_hand.isDefined() and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        found = set_by_hand.get() if set_by_hand.isDefined() else _own_dir()
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Have Hadoop's file system delete ``path`` when the driver's JVM ends: results are lazy and may be read until then."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing else has."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    forget_at_exit(spark, path)
    return path
