"""Kaplan–Meier survival and restricted mean residual life.

Customers are first aggregated to ``(group, month)`` counts, so every window
below runs over distinct months (at most 101 per group after the quality gate),
never over customers. The per-group expected-remaining table is evaluated on a
dense month grid and joined back to the customers by ``(group, tenure)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens import config as C
from churnlens.functions.columns import fixed


def km_curve(df: DataFrame, group: str = "plan", duration: str = "tenure",
             event: str = "churned") -> DataFrame:
    """``(group, t, n_at_time, deaths, at_risk, surv)`` at every distinct duration.

    ``at_risk`` = #(duration >= t); ``surv`` = running product of
    ``1 - deaths/at_risk``; censored-only times are kept with no drop.
    """
    counts = df.groupBy(group, F.col(duration).alias("t")).agg(
        F.count(F.lit(1)).alias("n_at_time"),
        F.sum(F.col(event).cast("long")).alias("deaths"))
    suffix = Window.partitionBy(group).orderBy(F.col("t").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    prefix = Window.partitionBy(group).orderBy("t").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (counts.withColumn("at_risk", F.sum("n_at_time").over(suffix))
            .withColumn("surv", F.product(F.lit(1.0) - F.col("deaths") / F.col("at_risk")).over(prefix)))


def km_remaining(curve: DataFrame, group: str = "plan",
                 horizon: int = C.CLV_HORIZON_MONTHS) -> DataFrame:
    """``(group, tenure, surv, expected_months)`` on the dense grid 0..max_t+horizon.

    ``S(q)`` is the step lookup (last S at time <= q, 1.0 before the first time,
    flat after the last); ``expected_months = sum_{m=1..H} S(t+m) / S(t)`` and 0
    where ``S(t) <= 1e-9``.
    """
    grid = (curve.groupBy(group).agg(F.max("t").alias("max_t"))
            .select(group, F.explode(F.sequence(F.lit(0), F.col("max_t") + F.lit(horizon))).alias("tenure")))
    joined = grid.join(curve.select(group, F.col("t").alias("tenure"), "surv"),
                       [group, "tenure"], "left")
    fill = Window.partitionBy(group).orderBy("tenure").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(group).orderBy("tenure").rowsBetween(1, horizon)
    stepped = joined.withColumn(
        "surv", F.coalesce(F.last("surv", ignorenulls=True).over(fill), F.lit(1.0)))
    remaining = F.when(F.col("surv") <= F.lit(1e-9), F.lit(0.0)).otherwise(
        F.sum("surv").over(ahead) / F.col("surv"))
    return stepped.withColumn("expected_months", fixed(remaining, 6))


def expected_remaining_by_group(df: DataFrame, group: str = "plan", duration: str = "tenure",
                                event: str = "churned",
                                horizon: int = C.CLV_HORIZON_MONTHS) -> DataFrame:
    """Attach ``expected_months`` to every row from its group's KM curve.

    The lookup table has at most |groups| x (101 + horizon) rows (tenure is
    gated to [0, 100] and the group column is the 3-valued plan), so it is
    broadcast; the customer side is never shuffled for this join.
    """
    table = km_remaining(km_curve(df, group, duration, event), group, horizon)
    lookup = table.select(group, F.col("tenure").alias(duration), "expected_months")
    return df.join(F.broadcast(lookup), [group, duration], "left")
