"""Cleaning and the declarative data-quality gate.

``clean_customers`` renames the id, coerces the dirty ``TotalCharges`` string
(blank -> 0.0), maps the label and drops it. ``dq_violations`` evaluates every
rule in a single shuffle on ``customer_id`` (uniqueness needs it anyway; the
partial aggregate collapses a hot id before the shuffle) and returns one row per
rule. ``validate_customers`` runs it once and raises when anything fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens import config as C

REQUIRED_COLUMNS = ["customerID", "Contract", "tenure", "MonthlyCharges",
                    "TotalCharges", "Churn"]

RULES = ["non_empty", "customer_id_not_null", "customer_id_unique", "tenure_in_0_100",
         "monthly_charges_gt_0", "total_charges_ge_0", "contract_in_plans",
         "churned_in_0_1"]


def check_required_columns(df: DataFrame, required=REQUIRED_COLUMNS) -> None:
    """Schema-only check (no job): raise naming every missing column."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Dataset is missing required columns: {missing}")


def clean_customers(raw: DataFrame, required=REQUIRED_COLUMNS) -> DataFrame:
    """Rename id, coerce TotalCharges leniently, map Churn -> churned (0/1)."""
    check_required_columns(raw, required)
    total = F.coalesce(F.expr("try_cast(trim(TotalCharges) AS DOUBLE)"), F.lit(0.0))
    return (raw.withColumnRenamed("customerID", "customer_id")
            .withColumn("TotalCharges", total)
            .withColumn("tenure", F.col("tenure").cast("int"))
            .withColumn("MonthlyCharges", F.col("MonthlyCharges").cast("double"))
            .withColumn("churned", F.when(F.col("Churn") == "Yes", 1).otherwise(0))
            .drop("Churn"))


def _broken() -> dict[str, Column]:
    """Rules of one cleaned row: name -> does the row break it."""
    return {
        "tenure_in_0_100": ~F.coalesce((F.col("tenure") >= 0) & (F.col("tenure") <= 100), F.lit(False)),
        "monthly_charges_gt_0": ~F.coalesce(F.col("MonthlyCharges") > 0, F.lit(False)),
        "total_charges_ge_0": ~F.coalesce(F.col("TotalCharges") >= 0, F.lit(False)),
        "contract_in_plans": ~F.coalesce(F.col("Contract").isin(*C.PLANS), F.lit(False)),
        "churned_in_0_1": ~F.coalesce(F.col("churned").isin(0, 1), F.lit(False)),
    }


def mark_violations(raw: DataFrame) -> DataFrame:
    """Raw records with ``broken_rules``, the names of the gate's rules that each breaks; every
    record of an id that occurs more than once breaks ``customer_id_unique``."""
    whole = raw.withColumn("__raw", F.struct(*raw.columns))
    twice = (raw.where(F.col("customerID").isNotNull()).groupBy("customerID").agg(F.count(F.lit(1)).alias("__n"))
             .where("__n > 1").withColumnRenamed("customerID", "__id"))
    cleaned = clean_customers(whole).join(twice, F.col("customer_id") == F.col("__id"), "left")
    broken = {"customer_id_not_null": F.col("customer_id").isNull(), "customer_id_unique": F.col("__n").isNotNull(), **_broken()}
    names = F.filter(F.array(*[F.when(cond, name) for name, cond in broken.items()]), lambda r: r.isNotNull())
    return cleaned.select(names.alias("broken_rules"), "__raw").select("__raw.*", "broken_rules")


def dq_violations(df: DataFrame) -> DataFrame:
    """One row per rule: ``(rule, violations)``; all zeros means the table passes."""
    bad = _broken()
    per_id = df.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.when(cond, 1).otherwise(0)).alias(name) for name, cond in bad.items()])
    totals = per_id.agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("customer_id").isNull(), F.col("n"))), F.lit(0)).alias("customer_id_not_null"),
        F.coalesce(F.sum(F.when(F.col("customer_id").isNotNull() & (F.col("n") > 1), F.col("n"))),
                   F.lit(0)).alias("customer_id_unique"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in bad])
    totals = totals.withColumn(
        "non_empty", F.when(F.coalesce(F.col("rows"), F.lit(0)) == 0, 1).otherwise(0))
    stack = ", ".join(f"'{r}', CAST({r} AS BIGINT)" for r in RULES)
    return totals.selectExpr(f"stack({len(RULES)}, {stack}) AS (rule, violations)")


def validate_customers(df: DataFrame) -> DataFrame:
    """Run the gate (one job) and raise ``ValueError`` on any violation."""
    failed = [(r["rule"], r["violations"]) for r in dq_violations(df).collect()
              if r["violations"]]
    if failed:
        if any(rule == "non_empty" for rule, _ in failed):
            raise ValueError("Dataset is empty")
        raise ValueError(f"Data-quality gate failed: {failed}")
    return df
