"""Uplift evaluation: Qini curve, Qini coefficient, average treatment effect.

The Qini curve needs cumulative treated/control counts and responders in score
order over *all* rows; they come from the two-level prefix sum (range-partitioned,
checkpointed, per-partition offsets), optionally per ranking so several rankings
are evaluated in one pass. The coefficient needs no curve: every partition gives one row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.columns import fixed
from churnlens.functions.prefix import RangeOrdered


def qini_curve(df: DataFrame, score: str = "score", treat: str = "treat", outcome: str = "outcome",
               id_col: str = "customer_id", by: list[str] = ()) -> DataFrame:
    """Per row in ``score`` descending order (ties by id): ``rank, fraction, qini`` with
    ``qini = r_t - r_c * n_t / n_c`` (ratio 0 while ``n_c = 0``)."""
    t = F.col(treat).cast("long")
    o = F.col(outcome).cast("long")
    base = df.select(*by, id_col, score, treat, outcome)
    run = RangeOrdered(base, [F.col(score).desc(), F.col(id_col).asc()], partition_by=list(by)).running(
        {"n_t": t, "n_c": 1 - t, "r_t": o * t, "r_c": o * (1 - t)}, rn="rank")
    n = (base.groupBy(*by).agg(F.count(F.lit(1)).alias("n")) if by else None)
    if n is not None:
        run = run.join(F.broadcast(n), list(by))  # one row per ranking
        total = F.col("n")
    else:
        total = base.select(F.count(F.lit(1))).scalar()
    ratio = F.when(F.col("n_c") > 0, F.col("n_t") / F.col("n_c")).otherwise(F.lit(0.0))
    return run.select(*by, id_col, "rank", (F.col("rank") / total).alias("fraction"),
                      (F.col("r_t") - F.col("r_c") * ratio).alias("qini"))


def qini_summary(df: DataFrame, score: str = "score", treat: str = "treat", outcome: str = "outcome",
                 id_col: str = "customer_id", by: list[str] = ()) -> DataFrame:
    """:func:`qini_coefficient` of the Qini curve without the curve: every range partition gives
    its partial area and what it has of the curve's ends."""
    t, o, by = F.col(treat).cast("long"), F.col(outcome).cast("long"), list(by)

    def boil(rows, places, run, totals):
        def height(n_t, n_c, r_t, r_c):
            return r_t - r_c * np.divide(n_t, n_c, out=np.zeros(len(n_c)), where=n_c > 0)
        last = float(height(*[np.array([totals[k]], float) for k in ("n_t", "n_c", "r_t", "r_c")])[0])
        d = height(*[run[k].astype(float) for k in ("n_t", "n_c", "r_t", "r_c")]) - places / totals["n"] * last
        return [(int(totals["n"]), last, float(d.sum()), float(d[0]) if places[0] == 1 else None,
                 float(d[-1]) if places[-1] == totals["n"] else None)]

    parts = RangeOrdered(df.select(*by, id_col, score, treat, outcome), [F.col(score).desc(), F.col(id_col).asc()], partition_by=by).reduce(
        {"n_t": t, "n_c": 1 - t, "r_t": o * t, "r_c": o * (1 - t)}, boil, "n long, qini_final double, sd double, d_first double, d_last double")
    agg = parts.groupBy(*by).agg(F.max("n").alias("n"), F.max("qini_final").alias("qini_final"), F.sum("sd").alias("sd"),
                                 F.max("d_first").alias("d_first"), F.max("d_last").alias("d_last"))
    return agg.select(
        *by, F.coalesce("n", F.lit(0)).alias("n"), fixed("qini_final", 6).alias("qini_final"),
        fixed((F.col("sd") - (F.col("d_first") + F.col("d_last")) / 2) / F.col("n"), 6).alias("qini_coefficient"))


def qini_coefficient(curve: DataFrame, by: list[str] = ()) -> DataFrame:
    """Trapezoid area of ``qini - fraction * qini_final`` over the fractions
    ``1/n .. 1``: ``(sum d - (d_first + d_last) / 2) / n``."""
    final = curve.groupBy(*by).agg(F.max_by("qini", "rank").alias("q_last"))
    if by:
        d = curve.join(F.broadcast(final), list(by))  # one row per ranking
    else:
        d = curve.withColumn("q_last", final.select("q_last").scalar())
    d = d.withColumn("d", F.col("qini") - F.col("fraction") * F.col("q_last"))
    agg = d.groupBy(*by).agg(F.sum("d").alias("sd"), F.max_by("d", "rank").alias("d_last"),
                             F.min_by("d", "rank").alias("d_first"), F.count(F.lit(1)).alias("n"),
                             F.max_by("qini", "rank").alias("qini_final"))
    return agg.select(*by, "n", fixed("qini_final", 6).alias("qini_final"),
                      fixed((F.col("sd") - (F.col("d_first") + F.col("d_last")) / 2) / F.col("n"), 6)
                      .alias("qini_coefficient"))


def treatment_effect(df: DataFrame, treat: str = "treat", outcome: str = "outcome") -> DataFrame:
    """Difference in mean outcome, treated minus control (1 row)."""
    t = F.col(treat) == 1
    return df.agg(
        F.count(F.when(t, 1)).alias("n_treated"), F.count(F.when(~t, 1)).alias("n_control"),
        fixed(F.avg(F.when(t, F.col(outcome))), 6).alias("treated_rate"),
        fixed(F.avg(F.when(~t, F.col(outcome))), 6).alias("control_rate"),
        fixed(F.avg(F.when(t, F.col(outcome))) - F.avg(F.when(~t, F.col(outcome))), 6).alias("ate"))


def outcome_models(frames: list[DataFrame], features_numeric, features_categorical, gbt_iter: int = 100,
                   seed: int = 42, outcome: str = "outcome") -> list:
    """One boosted-tree outcome model per frame, fitted at once on packed copies."""
    from churnlens.operators.model import fit_all, gbt_pipeline, packed
    rows = [packed(df, outcome, *features_numeric, *features_categorical) for df in frames]
    models = fit_all([(gbt_pipeline(seed, gbt_iter, numeric=features_numeric, categorical=features_categorical,
                                    label=outcome), r) for r in rows])
    for r in rows:
        r.unpersist()
    return models


def arms(df: DataFrame, treat: str = "treat") -> list[DataFrame]:
    """(treated rows, control rows)."""
    return [df.where(F.col(treat) == 1), df.where(F.col(treat) == 0)]


def two_model_uplift(df: DataFrame, features_numeric, features_categorical, gbt_iter: int = 100,
                     seed: int = 42, treat: str = "treat", outcome: str = "outcome", models=None) -> DataFrame:
    """T-learner: one boosted-tree outcome model on treated rows, one on control
    rows (or those given as ``models``); ``uplift = p_treated(x) - p_control(x)`` for every row."""
    from churnlens.operators.model import with_probability
    t_model, c_model = models or outcome_models(arms(df, treat), features_numeric, features_categorical, gbt_iter, seed, outcome)
    both = with_probability(with_probability(df, t_model, "p_t"), c_model, "p_c")
    return both.withColumn("uplift", F.col("p_t") - F.col("p_c"))


def response_propensity(df: DataFrame, features_numeric, features_categorical, gbt_iter: int = 100,
                        seed: int = 42, outcome: str = "outcome", model=None) -> DataFrame:
    """One outcome model (or the ``model`` given) that ignores treatment (the propensity baseline)."""
    from churnlens.operators.model import with_probability
    m = model or outcome_models([df], features_numeric, features_categorical, gbt_iter, seed, outcome)[0]
    return with_probability(df, m, "propensity")
