"""Model-evaluation queries over ``(y, p[, clv, cost])`` tables.

* ROC AUC as a rank statistic (ties count 1/2): rows are first collapsed to
  distinct scores, and every range partition gives its partial area and counts,
  which merge by sums — never a single-partition window over rows.
* Threshold metrics and Brier in one aggregate.
* Profit-maximising cutoff on the 51-point grid: one ``groupBy(bucket)`` and a
  suffix sum over at most 52 bucket rows.
* Calibration table with quantile bins (duplicate edges dropped, right-closed,
  lowest included); bin edges are exact distributed quantiles.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens import config as C
from churnlens.functions.columns import fixed, micro
from churnlens.functions.prefix import RangeOrdered
from churnlens.functions.quantiles import column_quantiles

DECILE_LEVELS = [float(v) for v in np.linspace(0, 1, 11)]
CUTOFFS = [k / C.PROFIT_STEPS for k in range(C.PROFIT_STEPS + 1)]


def roc_auc(df: DataFrame, y: str = "churned", p: str = "churn_probability", by: list[str] = ()) -> DataFrame:
    """One row ``roc_auc`` per group of ``by`` (NULL when a class is absent)."""
    by = list(by)
    per_p = df.groupBy(*by, F.col(p).alias("score")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"),
        F.sum((1 - F.col(y)).cast("long")).alias("neg"))
    def boil(rows, places, run, totals):
        # pos * (2 * negatives strictly below + negatives tied), summed exactly
        pos, neg = rows["pos"].fillna(0).to_numpy(object), rows["neg"].fillna(0).to_numpy(object)
        twice = sum((p * (2 * int(c) - q) for p, q, c in zip(pos, neg, run["cneg"])), 0)
        return [(Decimal(int(twice)), int(sum(pos)), int(sum(neg)))]

    tot = (RangeOrdered(per_p, [F.col("score").asc()], partition_by=by)
           .reduce({"cneg": F.col("neg")}, boil, "num decimal(38,0), P long, N long")
           .groupBy(*by).agg(F.sum("num").alias("num"), F.sum("P").alias("P"), F.sum("N").alias("N")))
    return tot.select(*by, F.when((F.col("P") > 0) & (F.col("N") > 0),
                                  fixed(F.col("num").cast("double") / (F.lit(2.0) * F.col("P").cast("double") * F.col("N").cast("double")), 6))
                      .alias("roc_auc"))


def classification_metrics(df: DataFrame, y: str = "churned", p: str = "churn_probability",
                           threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 at ``threshold``; Brier; mean / max p; share p >= 0.60."""
    pred = F.col(p) >= F.lit(threshold)
    pos = F.col(y) == 1
    agg = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(pred & pos, 1)).alias("tp"), F.count(F.when(pred & ~pos, 1)).alias("fp"),
        F.count(F.when(~pred & pos, 1)).alias("fn"), F.count(F.when(~pred & ~pos, 1)).alias("tn"),
        F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"),
        F.avg(p).alias("mean_p"), F.max(p).alias("max_p"),
        F.avg(F.when(F.col(p) >= F.lit(C.RISK_HIGH), 1.0).otherwise(0.0)).alias("share_hi"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return (agg.withColumn("precision_churn", prec).withColumn("recall_churn", rec)
            .select(fixed((F.col("tp") + F.col("tn")) / F.col("n"), 6).alias("accuracy"),
                    fixed("precision_churn", 6).alias("precision_churn"),
                    fixed("recall_churn", 6).alias("recall_churn"),
                    F.when(F.col("precision_churn") + F.col("recall_churn") > 0,
                           fixed(F.lit(2.0) * F.col("precision_churn") * F.col("recall_churn")
                                 / (F.col("precision_churn") + F.col("recall_churn")), 6))
                    .otherwise(0.0).alias("f1_churn"),
                    fixed("brier", 6).alias("brier_score"),
                    fixed("mean_p", 6).alias("mean_predicted_prob"),
                    fixed("max_p", 6).alias("max_predicted_prob"),
                    fixed("share_hi", 6).alias("share_prob_ge_060")))


def profit_curve(df: DataFrame, save_rate: float = C.SAVE_RATE, y: str = "churned",
                 p: str = "churn_probability", clv: str = "CLV", cost: str = "retention_cost") -> DataFrame:
    """Realised value of acting on ``p >= t`` for t = 0, 0.02, ..., 1:
    ``sum(save_rate * y * clv - cost)`` (integer micro-units)."""
    cut = F.lit(CUTOFFS)
    # bucket = number of cutoffs <= p, compared against the literal grid
    bucket = F.size(F.filter(cut, lambda t: t <= F.col(p)))
    per = micro(F.lit(float(save_rate)) * F.col(y) * F.col(clv) - F.col(cost))
    sums = df.groupBy(bucket.alias("b")).agg(F.sum(per).alias("s"))
    ks = df.sparkSession.range(len(CUTOFFS)).select(F.col("id").cast("int").alias("k"))
    # value(t_k) = sum over buckets b >= k + 1; at most 52 bucket rows, so one
    # small window is bounded work
    suffix = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grid = ks.join(sums, ks.k + 1 == sums.b, "left").select("k", F.coalesce("s", F.lit(0)).alias("s"))
    return (grid.withColumn("value_micro", F.sum("s").over(suffix))
            .select("k", (F.col("k") / F.lit(float(C.PROFIT_STEPS))).alias("threshold"),
                    (F.col("value_micro") / F.lit(float(C.MICRO))).alias("value")))


def profit_threshold(curve: DataFrame) -> DataFrame:
    """Best cutoff (first argmax), its value, the value at 0.5 and the gain over it."""
    half = CUTOFFS.index(0.5)
    return curve.agg(
        F.min_by("threshold", F.struct(-F.col("value"), F.col("k"))).alias("best_threshold"),
        F.max("value").alias("best_value"),
        F.max(F.when(F.col("k") == half, F.col("value"))).alias("value_at_half")).select(
        fixed("best_threshold", 3).alias("best_threshold"), fixed("best_value", 4).alias("best_value"),
        fixed("value_at_half", 4).alias("value_at_half"),
        fixed(F.col("best_value") - F.col("value_at_half"), 4).alias("gain_over_half"))


def calibration_table(df: DataFrame, y: str = "churned", p: str = "churn_probability") -> DataFrame:
    """Quantile-bin calibration: ``(decile, customers, avg_predicted, actual_churn_rate)``."""
    edges = F.sort_array(F.array_distinct(column_quantiles(df, [p], DECILE_LEVELS).getField(p)))
    # inner edges: all but the first and the last distinct edge (at most 9)
    inner_n = F.greatest(F.size(edges) - 2, F.lit(0))
    bin_ = F.lit(0)
    for j in range(1, len(DECILE_LEVELS) - 1):
        e = F.try_element_at(edges, F.lit(j + 1))
        bin_ = bin_ + F.when((F.lit(j) <= inner_n) & (e < F.col(p)), 1).otherwise(0)
    return (df.withColumn("decile", bin_).groupBy("decile")
            .agg(F.count(F.lit(1)).alias("customers"),
                 fixed(F.avg(p), 3).alias("avg_predicted"),
                 fixed(F.avg(y), 3).alias("actual_churn_rate")))
