"""Per-account economics (plan, MRR, CLV, retention cost) and scoring columns."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens import config as C
from churnlens.functions.columns import fixed, retention_cost, risk_band, scorecard_probability
from churnlens.operators.survival import expected_remaining_by_group

log = logging.getLogger(__name__)


def add_economic_fields(accounts: DataFrame, method: str = "km",
                        horizon: int = C.CLV_HORIZON_MONTHS) -> DataFrame:
    """Add ``plan, MRR, expected_months, CLV, retention_cost``.

    ``method="km"``: per-plan Kaplan–Meier residual life. ``method="cox"``: the
    per-account Cox model (``operators.cox``), used when the table has at least
    ``MIN_COX_ROWS`` rows and every estimate is positive, else KM — the fallback
    is logged, and the chosen method is kept in column ``clv_method``.
    """
    df = accounts.withColumn("plan", F.col("Contract")).withColumn("MRR", F.col("MonthlyCharges"))
    if method == "cox":
        from churnlens.operators.cox import cox_expected_remaining_checked
        with_rem = cox_expected_remaining_checked(df, horizon)
        if with_rem is not None:
            df = with_rem.withColumn("clv_method", F.lit("cox"))
        else:
            log.warning("Cox fit unavailable or invalid; falling back to Kaplan-Meier")
            df = expected_remaining_by_group(df, "plan", "tenure", "churned", horizon) \
                .withColumn("clv_method", F.lit("km"))
    else:
        df = expected_remaining_by_group(df, "plan", "tenure", "churned", horizon)
    return (df.withColumn("CLV", fixed(F.col("MRR") * F.col("expected_months"), 4))
            .withColumn("retention_cost", retention_cost("plan", "MRR")))


def score_with_scorecard(econ: DataFrame) -> DataFrame:
    """Scored table from the fixed scorecard: probability, band, diagnostic losses."""
    p = scorecard_probability("tenure", "MonthlyCharges", "plan")
    return add_score_columns(econ.withColumn("churn_probability", p))


def add_score_columns(scored: DataFrame) -> DataFrame:
    """Risk band and diagnostic losses for any table that has ``churn_probability``."""
    p = F.col("churn_probability")
    return (scored.withColumn("risk_band", risk_band(p))
            .withColumn("loss_if_act", fixed((F.lit(1.0) - p) * F.col("retention_cost"), 4))
            .withColumn("loss_if_ignore", fixed(p * F.col("CLV"), 4)))
