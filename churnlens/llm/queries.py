"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import (
    bestfit, crosspolytope, decontaminate, hyperlang, merkle, pii, ppm, prefix_tokens, recompress, records, sigtree, toxicity, variants)
from churnlens.llm.common import read_table, shared_folder

#: Stands in for a secret that a deployment passes to the operator.
PSEUDONYM_KEY = "pseudonym-key-of-the-registered-queries"
BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in record files, read back."""
    folder = shared_folder(spark, "token-records")
    index = records.write_records(read_table(spark, sf_dir, "documents"), folder, tokenizer_path())
    return records.read_records(spark, folder, index)


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal values replaced by pseudonyms."""
    return pii.private_values(read_table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words found in all documents."""
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths of all documents under byte contexts of the training fold."""
    return ppm.score_documents(read_table(spark, sf_dir, "documents"), ppm.training_fold(F.col("doc_id")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into bins of 2048 words, near copies apart."""
    return bestfit.pack_documents(read_table(spark, sf_dir, "documents"), near=True)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every 20th vector among all vectors."""
    return crosspolytope.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that repeat 50-word passages of earlier documents."""
    return recompress.substring_dedup(read_table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-equal documents: five-word shingles, 75 percent."""
    return sigtree.jaccard_components(read_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents; one fold of the labels is never learnt from."""
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), toxicity.training_fold)
    return toxicity.scores(docs, model).select(
        "doc_id", (~toxicity.training_fold(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents from prefix tables."""
    return prefix_tokens.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents, the words they are variants of, and the roots these lead to."""
    return variants.variants(variants.vocabulary(read_table(spark, sf_dir, "documents"), variants.damaged))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and verification of every document; those with an even checksum of their id
    are verified with a text that lost its line ends."""
    return merkle.manifest(read_table(spark, sf_dir, "documents"), merkle.without_line_ends())


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; one fold is never learnt from."""
    docs = read_table(spark, sf_dir, "documents")
    learns = F.coalesce(hyperlang.training_fold(F.col("doc_id")), F.lit(True))
    model = hyperlang.train(docs.where(learns).select("text", "lang"))
    return hyperlang.predict(docs, model).select("doc_id", (~learns).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_token_records": op1_token_records,
    "op2_pseudonyms": op2_pseudonyms,
    "op3_decontamination": op3_decontamination,
    "op4_scores": op4_scores,
    "op5_packing": op5_packing,
    "op6_neighbours": op6_neighbours,
    "op7_repeats": op7_repeats,
    "op8_jaccard": op8_jaccard,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_language_id": op13_language_id,
}
ORACLE: dict[str, str] = {
    "op3_decontamination": decontaminate.CONTAMINATION_SQL,
    "op11_spelling_variants": variants.VARIANTS_SQL,
    "op12_merkle_manifest": merkle.MANIFEST_SQL,
}
