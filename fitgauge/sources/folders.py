"""Shared folders for tables that cut a job in two."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def work_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared folder, for tables that cut a job in two.

    Only a local session without the setting falls back to the machine's own temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and spark.sparkContext.master.startswith("local"):
        shared = tempfile.mkdtemp(prefix="fitgauge-")
    if shared is None:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return until_end(spark, f"{shared.rstrip('/')}/fitgauge-{uuid.uuid4().hex}")


def until_end(spark: SparkSession, path: str) -> str:
    """The path, whose files go when the application ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path
