"""Outcome distribution of a funded set under uncertainty (Monte Carlo).

Per scenario s: a true save rate drawn from Beta(mean = assumed rate, sd =
``rate_std``, variance capped at 0.99 m(1-m)); per (scenario, customer): churns
~ Bernoulli(p), offer works ~ Bernoulli(rate_s); realized net = sum over saved
churners of CLV - total cost.

All draws are ``md5(seed | stream | scenario | id)`` uniforms, so results do not
depend on partitioning. The Beta draw is an inverse-CDF lookup on a fixed grid of
``grid`` midpoints whose densities are held as integers (exact cumulative sums).
The expansion (funded rows x scenarios) is a per-row ``explode`` followed by a
partial aggregate by scenario; the scenario table (n_sims rows, a parameter) is
the only broadcast side.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens import config as C
from churnlens.functions.columns import fixed, hash_uniform, micro

DENSITY_SCALE = 2.0 ** 36  # keeps the integer cumulative sum below 2**53


def beta_parameters(mean: float, sd: float) -> tuple[float, float]:
    var = min(sd ** 2, mean * (1 - mean) * 0.99)
    conc = mean * (1 - mean) / var - 1
    return mean * conc, (1 - mean) * conc


def beta_cdf_table(a: float, b: float, grid: int) -> list[float]:
    """Cumulative shares on the midpoint grid, from integer densities.

    Parameter-sized (``grid`` entries, independent of the data)."""
    x = (np.arange(grid) + 0.5) / grid
    logd = (a - 1) * np.log(x) + (b - 1) * np.log(1 - x)
    d = np.exp(logd)
    ints = np.floor(d / d.max() * DENSITY_SCALE).astype(np.int64)
    cum = np.cumsum(ints)
    return (cum / cum[-1]).tolist()


def beta_cdf_frame(spark, a: float, b: float, grid: int) -> DataFrame:
    """``(j, value)``: the cumulative share at grid point j, computed in Spark.

    Densities become integers relative to their maximum, so the running sum is
    exact in any order; the window covers ``grid`` rows (a parameter)."""
    x = (F.col("j") + F.lit(0.5)) / F.lit(float(grid))
    dens = F.exp((F.lit(a) - 1) * F.log(x) + (F.lit(b) - 1) * F.log(F.lit(1.0) - x))
    g = spark.range(grid).select(F.col("id").cast("int").alias("j")).withColumn("d", dens)
    dmax = g.select(F.max("d")).scalar()
    g = g.withColumn("di", F.floor(F.col("d") / dmax * F.lit(DENSITY_SCALE)).cast("bigint"))
    total = g.select(F.sum("di")).scalar()
    run = Window.orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return g.select("j", (F.sum("di").over(run).cast("double") / total.cast("double")).alias("value"))


def scenario_outcomes(act: DataFrame, assumed_save_rate: float, n_sims: int = C.N_SIMS,
                      rate_std: float = C.RATE_STD, seed: int = C.SEED, grid: int = 10_000) -> DataFrame:
    """``(scenario, net, roi)`` per simulated scenario (no rows for an empty or
    cost-free funded set)."""
    spark = act.sparkSession
    a, b = beta_parameters(float(assumed_save_rate), rate_std)
    # inverse-CDF lookup as a sorted as-of match: the first grid index j with
    # cdf_j >= u is the running minimum of j over rows with value >= u (grid rows
    # sort before draws on ties). n_sims + grid rows, both parameters.
    table = beta_cdf_frame(spark, a, b, grid)
    draws_u = (spark.range(n_sims).select(F.col("id").cast("int").alias("scenario"))
               .withColumn("value", hash_uniform(F.lit(f"{seed}|rate|"), F.col("scenario"))))
    events = (table.select("value", F.col("j").cast("int").alias("j"), F.lit(None).cast("int").alias("scenario"),
                           F.lit(1).alias("kind"))
              .unionByName(draws_u.select("value", F.lit(None).cast("int").alias("j"), "scenario",
                                          F.lit(0).alias("kind"))))
    ahead = Window.orderBy(F.col("value").desc(), F.col("kind").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    scenarios = (events.withColumn("jmin", F.min("j").over(ahead)).where(F.col("kind") == 0)
                 .select("scenario", ((F.col("jmin") + F.lit(0.5)) / F.lit(float(grid))).alias("rate")))

    total_cost = act.select(F.sum(micro("retention_cost"))).scalar()
    draws = act.select("customer_id", "churn_probability", micro("CLV").alias("clv_micro"),
                       F.explode(F.sequence(F.lit(0), F.lit(n_sims - 1))).alias("scenario"))
    draws = draws.join(F.broadcast(scenarios), "scenario")
    churn_u = hash_uniform(F.lit(f"{seed}|churn|"), F.col("scenario"), F.lit("|"), F.col("customer_id"))
    save_u = hash_uniform(F.lit(f"{seed}|save|"), F.col("scenario"), F.lit("|"), F.col("customer_id"))
    hit = (churn_u < F.col("churn_probability")) & (save_u < F.col("rate"))
    per_s = draws.groupBy("scenario").agg(F.sum(F.when(hit, F.col("clv_micro")).otherwise(0)).alias("gross"))
    return (per_s.select("scenario", ((F.col("gross") - total_cost) / F.lit(float(C.MICRO))).alias("net"),
                         ((F.col("gross") - total_cost) / total_cost).alias("roi"))
            .where(F.coalesce(total_cost, F.lit(0)) > 0))


def simulate_outcomes(act: DataFrame, assumed_save_rate: float, n_sims: int = C.N_SIMS,
                      rate_std: float = C.RATE_STD, seed: int = C.SEED, grid: int = 10_000) -> DataFrame:
    """One summary row; no row when the funded set is empty or costs nothing."""
    per_s = scenario_outcomes(act, assumed_save_rate, n_sims, rate_std, seed, grid)
    total_cost = act.select(F.sum(micro("retention_cost"))).scalar()
    return (per_s.agg(
        fixed(F.avg("net"), 4).alias("net_mean"),
        fixed(F.percentile("net", 0.05), 4).alias("net_p5"),
        fixed(F.percentile("net", 0.95), 4).alias("net_p95"),
        fixed(F.avg("roi"), 6).alias("roi_mean"),
        fixed(F.percentile("roi", 0.05), 6).alias("roi_p5"),
        fixed(F.percentile("roi", 0.95), 6).alias("roi_p95"),
        fixed(F.avg(F.when(F.col("net") > 0, 1.0).otherwise(0.0)), 6).alias("prob_profitable"),
        F.count(F.lit(1)).alias("scenarios"))
        .select(F.lit(float(assumed_save_rate)).alias("assumed_save_rate"),
                fixed(total_cost / F.lit(float(C.MICRO)), 4).alias("cost"), "*")
        .where(F.coalesce(total_cost, F.lit(0)) > 0))


def roi_histogram(per_scenario: DataFrame, bins: int = 44) -> DataFrame:
    """Equal-width histogram of scenario ROI over [min, max] (last bin closed)."""
    rng = per_scenario.agg(F.min("roi").alias("lo"), F.max("roi").alias("hi")).select(
        F.struct(F.when(F.col("hi") > F.col("lo"), F.col("lo")).otherwise(F.col("lo") - 0.5).alias("lo"),
                 F.when(F.col("hi") > F.col("lo"), F.col("hi")).otherwise(F.col("hi") + 0.5).alias("hi"))).scalar()
    lo, hi = rng.getField("lo"), rng.getField("hi")
    idx = F.least(F.lit(bins - 1), F.floor((F.col("roi") - lo) * F.lit(float(bins)) / (hi - lo)).cast("int"))
    counts = per_scenario.withColumn("bin", idx).groupBy("bin").agg(F.count(F.lit(1)).alias("scenarios"))
    width = (hi - lo) / F.lit(float(bins))
    grid = per_scenario.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", fixed(lo + F.col("bin") * width, 6).alias("roi_lo"),
                    fixed(lo + (F.col("bin") + 1) * width, 6).alias("roi_hi"),
                    F.coalesce("scenarios", F.lit(0)).alias("scenarios")))


def expected_roi(act: DataFrame, assumed_save_rate: float) -> DataFrame:
    """Analytic mean ROI ``m * sum(p*CLV) / sum(cost) - 1`` (simulation check)."""
    return act.agg((F.lit(assumed_save_rate) * F.sum(F.col("churn_probability") * F.col("CLV"))
                    / F.sum("retention_cost") - 1).alias("expected_roi"))


__all__ = ["simulate_outcomes", "scenario_outcomes", "roi_histogram", "beta_parameters", "beta_cdf_table",
           "expected_roi"]
