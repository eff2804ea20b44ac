"""Sinks and checked sources: account table, model artifact, model card, ACT export."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def write_customers(df: DataFrame, path: str) -> str:
    """Replace-on-write account table (parquet)."""
    df.write.mode("overwrite").parquet(path)
    return path


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    """Scan the account table; a missing table raises with a hint."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"Account table not found at {path} - run the batch job first.")
    return spark.read.parquet(path)


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    if not _exists(spark, path):
        raise FileNotFoundError(f"Model pipeline not found at {path} - run the batch job first.")
    return PipelineModel.load(path)


def write_model_card(card: DataFrame, path: str) -> str:
    """One-row model card (structs / arrays of structs) as JSON."""
    card.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def read_model_card(spark: SparkSession, path: str) -> dict:
    if not _exists(spark, path):
        raise FileNotFoundError(f"Model card not found at {path} - run the batch job first.")
    row = spark.read.json(path).first()
    return json.loads(json.dumps(row.asDict(recursive=True)))


def export_act_list(act: DataFrame, path: str) -> str:
    """ACT list with a header row, net value descending (order kept by one sorted file
    per range partition, as written by ``orderBy``)."""
    act.write.mode("overwrite").option("header", True).csv(path)
    return path


__all__ = ["write_customers", "read_customers", "save_model", "load_model", "write_model_card",
           "read_model_card", "export_act_list"]
