"""Folders for what a session stores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session_folder(spark: SparkSession, name: str) -> str:
    """A new folder that goes when the session ends, in the shared folder spark.checkpoint.dir, else in the warehouse; a
    local session without the former gets a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        top = tempfile.mkdtemp(prefix="lodestone-") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir")
    path = f"{top.rstrip('/')}/lodestone-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
