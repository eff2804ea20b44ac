"""From raw documents to packed bins, in five stages.

Each stage takes what its predecessor kept, as Parquet, and all of it: toxic
documents go, one document of each group of near duplicates stays, documents with
benchmark passages go, personal values become pseudonyms, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from churnlens.llm import bestfit, decontaminate, pii, sigtree, toxicity
from churnlens.llm.common import read_table, stage
from churnlens.llm.queries import PSEUDONYM_KEY


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), toxicity.training_fold)
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return sigtree.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def hide_personal_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal values."""
    return pii.pseudonymise(docs, PSEUDONYM_KEY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents in bins: doc_id, piece, bin_id, start, length."""
    return bestfit.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pseudonyms", hide_personal_values),
    ("packing", pack),
]

#: The classifier, the permutations and the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
