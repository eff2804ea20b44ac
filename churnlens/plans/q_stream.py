"""Registered streaming queries: the micro-batch scorer's output (checked against
the batch SQL) and its per-batch drift reports (row-count check)."""

from __future__ import annotations

import os
import uuid

from churnlens.plans import base as B
from churnlens.plans import oracle as O
from churnlens.plans.registry import query
from churnlens.session import ensure_checkpoint_dir
from churnlens.sources.tables import raw_account_view
from churnlens.streaming.stream import run_scoring_stream

STREAM_COLS = ["customer_id", "plan", "segment", "region", "tenure", "MonthlyCharges", "TotalCharges",
               "churned", "MRR", "expected_months", "CLV", "retention_cost", "churn_probability", "risk_band"]
N_FILES = 2
_RUNS: dict = {}


def _run(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _RUNS:
        # shared folder named by the session (spark.checkpoint.dir), never local disk
        root = os.path.join(ensure_checkpoint_dir(spark), "churnlens-stream", uuid.uuid4().hex)
        src = os.path.join(root, "in")
        raw = raw_account_view(spark, sf_dir).drop("last_order", "as_of")
        raw.repartition(N_FILES, "customerID").write.parquet(src)
        _RUNS[key] = run_scoring_stream(spark, src, B.scored(spark, sf_dir), os.path.join(root, "out"),
                                        os.path.join(root, "checkpoint"), max_files_per_trigger=1)
    return _RUNS[key]


@query("stream_scores", O.base(f"SELECT {', '.join(STREAM_COLS)} FROM scored"))
def q_stream_scores(spark, sf_dir):
    """Accounts scored by the micro-batch stream (file source, availableNow, foreachBatch)."""
    return _run(spark, sf_dir)[0].select(*STREAM_COLS)


@query("stream_drift")
def q_stream_drift(spark, sf_dir):
    """Per-micro-batch drift report of streamed accounts against the reference table."""
    return _run(spark, sf_dir)[1].select("batch_id", "feature", "type", "psi", "ks_pvalue", "drift")
