"""Descriptive aggregations over the account economics table.

All are single ``groupBy`` aggregates (partial + final HashAggregate); averages of
fixed-decimal money are summed as integers so results do not depend on
partitioning. Grouping keys are low-cardinality, and partial aggregation makes a
hot key cost one row per input partition before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.columns import exact_avg, fixed, tenure_bucket

ATTRIBUTE_COLUMNS = ["plan", "segment", "region"]


def churn_summary(econ: DataFrame, by=("plan", "segment")) -> DataFrame:
    """Churn summary by plan and segment, highest churn first."""
    return (econ.groupBy(*by)
            .agg(F.count(F.lit(1)).alias("customers"),
                 fixed(F.avg("churned"), 3).alias("churn_rate"),
                 fixed(exact_avg("MRR", 2), 2).alias("avg_mrr"),
                 fixed(exact_avg("CLV", 4), 2).alias("avg_clv"))
            .orderBy(F.col("churn_rate").desc(), *by))


def churn_balance(econ: DataFrame) -> DataFrame:
    """Counts per label and share of the total (total as a scalar subquery)."""
    total = econ.select(F.count(F.lit(1))).scalar()
    return (econ.groupBy("churned").agg(F.count(F.lit(1)).alias("customers"))
            .withColumn("share", fixed(F.col("customers") / total, 4)))


def churn_overall(econ: DataFrame) -> DataFrame:
    """Overall churn rate and row count (1 row)."""
    return econ.agg(F.count(F.lit(1)).alias("n"), fixed(F.avg("churned"), 4).alias("churn_rate"))


def churn_by(econ: DataFrame, column: str) -> DataFrame:
    return (econ.groupBy(column)
            .agg(F.count(F.lit(1)).alias("customers"), fixed(F.avg("churned"), 4).alias("churn_rate"))
            .orderBy(F.col("churn_rate").desc(), column))


def churn_by_tenure_bucket(econ: DataFrame) -> DataFrame:
    """Churn rate per tenure bucket; tenures outside the buckets are dropped."""
    return (econ.withColumn("tenure_bucket", tenure_bucket("tenure"))
            .where(F.col("tenure_bucket").isNotNull())
            .groupBy("tenure_bucket")
            .agg(F.count(F.lit(1)).alias("customers"), fixed(F.avg("churned"), 4).alias("churn_rate")))


def churn_by_attribute(econ: DataFrame, columns=ATTRIBUTE_COLUMNS) -> DataFrame:
    """Churn rate for every value of several attributes in one pass (unpivot)."""
    long = econ.select("churned", *[F.col(c).cast("string") for c in columns]).unpivot(
        ["churned"], list(columns), "attribute", "value")
    return (long.where(F.col("value").isNotNull())
            .groupBy("attribute", "value")
            .agg(F.count(F.lit(1)).alias("customers"), fixed(F.avg("churned"), 4).alias("churn_rate")))


def plan_economics(econ: DataFrame) -> DataFrame:
    """Per plan: count, churn rate, mean MRR / CLV and the range of retention cost."""
    return (econ.groupBy("plan")
            .agg(F.count(F.lit(1)).alias("customers"),
                 fixed(F.avg("churned"), 2).alias("churn_rate"),
                 fixed(exact_avg("MRR", 2), 2).alias("avg_mrr"),
                 fixed(exact_avg("CLV", 4), 2).alias("avg_clv"),
                 fixed(F.max("retention_cost") - F.min("retention_cost"), 2).alias("retention_cost_spread")))


def charge_histogram(econ: DataFrame, column: str = "MonthlyCharges", bins: int = 30) -> DataFrame:
    """Equal-width histogram per churn class with density (all bins emitted).

    Bin ``i`` covers ``[lo + i*w, lo + (i+1)*w)``, the last bin is closed; a class
    with a single value uses the range ``[v - 0.5, v + 0.5]``.
    """
    rng = econ.groupBy("churned").agg(F.min(column).alias("mn"), F.max(column).alias("mx"),
                                      F.count(F.lit(1)).alias("n"))
    rng = (rng.withColumn("lo", F.when(F.col("mx") > F.col("mn"), F.col("mn")).otherwise(F.col("mn") - 0.5))
              .withColumn("hi", F.when(F.col("mx") > F.col("mn"), F.col("mx")).otherwise(F.col("mx") + 0.5)))
    idx = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("lo")) * F.lit(float(bins))
                                           / (F.col("hi") - F.col("lo"))).cast("int"))
    # per-class range table has one row per label (2 rows): broadcast is size-bounded
    counts = (econ.select("churned", column).join(F.broadcast(rng.select("churned", "lo", "hi")), "churned")
              .groupBy("churned", idx.alias("bin")).agg(F.count(F.lit(1)).alias("customers")))
    grid = rng.select("churned", "lo", "hi", "n",
                      F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return (grid.join(counts, ["churned", "bin"], "left")
            .select("churned", "bin",
                    fixed(F.col("lo") + F.col("bin") * width, 4).alias("bin_lo"),
                    fixed(F.col("lo") + (F.col("bin") + 1) * width, 4).alias("bin_hi"),
                    F.coalesce(F.col("customers"), F.lit(0)).alias("customers"),
                    fixed(F.coalesce(F.col("customers"), F.lit(0)) / (F.col("n") * width), 6).alias("density")))
