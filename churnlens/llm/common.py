"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions.scratch import drop
from churnlens.session import ensure_checkpoint_dir

__all__ = ["drop", "fresh", "lower_ascii", "partitions", "read_table", "shared_folder", "stage", "stage_at"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the checkpoint folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    survives lost executors. The folder belongs to the session's checkpoints."""
    return stage_at(df, name)[0]


def stage_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """:func:`stage` and the folder, for an owner that drops it when its readers have written."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character unchanged (``lower`` does just that to
    texts of ASCII alone, and faster)."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the one knob for the width of a job."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(columns: list[str], name: str) -> str:
    """A column name that none of ``columns`` has (letter case ignored)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
