"""Micro-batch scoring and drift monitoring with Structured Streaming.

``start_scoring_stream`` reads raw account records from a file source
(``readStream``), and in ``foreachBatch``:

1. cleans them (same operator as the batch path),
2. attaches expected remaining months from a *static* per-plan KM lookup built
   from the reference table (at most 3 x 161 rows, broadcast),
3. computes CLV, retention cost, the scorecard probability and the risk band,
4. writes the scored rows to ``{sink}/scores/batch_id=N``, the batch's value-count state
   (:mod:`churnlens.operators.drift`) to ``{sink}/state/batch_id=N`` and the state of all batches
   so far, the previous one's plus this batch's, to ``{sink}/running/batch_id=N``;
5. writes the drift reports of the batch (``{sink}/drift/batch_id=N``) and of all rows so far
   (``{sink}/drift_running/batch_id=N``) against the stored reference state, both in the same jobs.

Before 2, every record that breaks a rule of the quality gate (a rule of one row, or an id that the
batch holds twice) goes to ``{sink}/quarantine/batch_id=N`` with the names of the rules it breaks; the
batch goes on without it.

Each batch overwrites its own ``batch_id`` folders, and a running state is made from the folder of
the batch before, so a batch that is replayed after a failure counts once; progress lives in the
checkpoint folder.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions.columns import fixed, retention_cost
from churnlens.operators.drift import ReferenceProfile, drift_reports, merge_states, value_state
from churnlens.operators.economics import score_with_scorecard
from churnlens.operators.survival import km_curve, km_remaining
from churnlens.sources.quality import clean_customers, mark_violations
from churnlens.sources.tables import RAW_SCHEMA

NUMERIC = ["tenure", "MonthlyCharges", "TotalCharges"]
CATEGORICAL = ["plan", "segment", "region"]


def km_lookup(reference: DataFrame) -> DataFrame:
    """Static ``(plan, tenure, expected_months)`` table from the reference accounts."""
    ref = reference.select(F.col("plan"), "tenure", "churned")
    return km_remaining(km_curve(ref)).select("plan", "tenure", "expected_months")


def score_batch(raw: DataFrame, lookup: DataFrame) -> DataFrame:
    """Batch scoring of raw records (shared by the stream and its tests)."""
    acc = clean_customers(raw).withColumn("plan", F.col("Contract")).withColumn("MRR", F.col("MonthlyCharges"))
    econ = (acc.join(F.broadcast(lookup), ["plan", "tenure"], "left")   # <= 3 x 161 rows
            .withColumn("CLV", fixed(F.col("MRR") * F.col("expected_months"), 4))
            .withColumn("retention_cost", retention_cost("plan", "MRR")))
    return score_with_scorecard(econ)


def gate(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records that keep every rule of the quality gate, the others with ``broken_rules``)."""
    marked = mark_violations(batch)
    clean = F.size("broken_rules") == 0
    return marked.where(clean).drop("broken_rules"), marked.where(~clean)


def process_batch(batch: DataFrame, batch_id: int, lookup: DataFrame, profile: ReferenceProfile, sink_dir: str) -> None:
    """One micro-batch; done twice, it leaves the same folders as done once."""
    spark = batch.sparkSession

    def write(df: DataFrame, kind: str) -> DataFrame:
        path = os.path.join(sink_dir, kind, f"batch_id={batch_id}")
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    good, bad = gate(batch)
    write(bad, "quarantine")
    scored = write(score_batch(good, lookup), "scores")
    state = running = write(value_state(scored, NUMERIC, CATEGORICAL), "state")
    if batch_id > 0:
        before = os.path.join(sink_dir, "running", f"batch_id={batch_id - 1}")
        running = merge_states(spark.read.schema(state.schema).parquet(before), state)
    running = write(running, "running")
    reports = drift_reports(profile, {"drift": state, "drift_running": running}).persist()
    for kind in ("drift", "drift_running"):
        write(reports.where(F.col("label") == kind).drop("label").orderBy(F.col("psi").desc(), "feature"), kind)
    reports.unpersist()


def start_scoring_stream(spark: SparkSession, source_dir: str, reference: DataFrame, sink_dir: str,
                         checkpoint_dir: str, max_files_per_trigger: int | None = None):
    """Start the stream with ``availableNow`` (process what is there, then stop)."""
    lookup = km_lookup(reference).persist()
    # stored reference counts: computed once, reused by every micro-batch
    profile = ReferenceProfile(reference.select(*NUMERIC, *CATEGORICAL), NUMERIC, CATEGORICAL, persist=True)
    reader = spark.readStream.schema(RAW_SCHEMA).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source_dir)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        process_batch(batch, batch_id, lookup, profile, sink_dir)

    return (stream.writeStream.foreachBatch(per_batch)
            .option("checkpointLocation", checkpoint_dir)
            .trigger(availableNow=True).start())


def run_scoring_stream(spark: SparkSession, source_dir: str, reference: DataFrame, sink_dir: str,
                       checkpoint_dir: str, max_files_per_trigger: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Run to completion and return the scores and drift tables written by the stream."""
    q = start_scoring_stream(spark, source_dir, reference, sink_dir, checkpoint_dir, max_files_per_trigger)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return (spark.read.parquet(os.path.join(sink_dir, "scores")),
            spark.read.parquet(os.path.join(sink_dir, "drift")))
