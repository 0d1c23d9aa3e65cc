"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; only where it is unset, and on one machine, one of our own."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='checkpoints-')}")
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other call returns."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
