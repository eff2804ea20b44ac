"""Tables written to the shared checkpoint folder and deleted once they are read."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from churnlens.session import ensure_checkpoint_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new folder name that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder made by :func:`folder`."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
