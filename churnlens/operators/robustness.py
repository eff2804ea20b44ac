"""Set operations over ACT sets: strategy counterfactuals, the decision
boundary zone and stability under tighter constraints.

ACT sets are bounded by the capacity cap; set algebra is done once by pivoting
membership flags per customer (one shuffle on ``customer_id``), never with
per-pair comparisons.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens import config as C
from churnlens.functions.columns import fixed
from churnlens.operators import decision as D
from churnlens.operators.packing import greedy_pack_many

BOUNDARY_COLS = ["customer_id", "risk_band", "churn_probability", "CLV", "retention_cost",
                 "net_retention_value", "action_segment", "efficiency"]


def strategy_act_sets(scored: DataFrame, budget: float, max_customers: int | None,
                      save_rate: float = C.SAVE_RATE, decide_many=D.decide_many) -> tuple[DataFrame, dict]:
    """Long table ``(strategy, customer_id)`` of the three ACT sets, plus the decisions."""
    decs = decide_many(scored, [D.DecisionParams(budget, max_customers, s, save_rate) for s in C.STRATEGIES])
    decisions = dict(zip(C.STRATEGIES, decs))
    sets = reduce(DataFrame.unionByName, [
        d.funded.select(F.lit(s).alias("strategy"), "customer_id") for s, d in decisions.items()])
    return sets, decisions


def membership_flags(sets: DataFrame) -> DataFrame:
    """One row per customer in any ACT set with 0/1 flags ``a, b, c`` (aggressive,
    balanced, conservative) and ``n`` = number of sets containing it."""
    flag = {k: F.max(F.when(F.col("strategy") == s, 1).otherwise(0)).alias(k)
            for k, s in (("a", "Aggressive"), ("b", "Balanced"), ("c", "Conservative"))}
    return (sets.groupBy("customer_id").agg(*flag.values())
            .withColumn("n", F.col("a") + F.col("b") + F.col("c")))


def counterfactual_sets(flags: DataFrame) -> DataFrame:
    """``Aggressive_only`` = A-B, ``Balanced_only`` = B-C, ``Dropped_in_Conservative`` = A-C."""
    defs = [("Aggressive_only", (F.col("a") == 1) & (F.col("b") == 0)),
            ("Balanced_only", (F.col("b") == 1) & (F.col("c") == 0)),
            ("Dropped_in_Conservative", (F.col("a") == 1) & (F.col("c") == 0))]
    return reduce(DataFrame.unionByName, [
        flags.where(cond).select(F.lit(name).alias("set_name"), "customer_id") for name, cond in defs])


def boundary_sizes(flags: DataFrame) -> DataFrame:
    """Size of (union - intersection) and of C-B, B-C, A-B."""
    return flags.agg(
        F.count(F.when(F.col("n").isin(1, 2), 1)).alias("dbz_count"),
        F.count(F.when((F.col("c") == 1) & (F.col("b") == 0), 1)).alias("conservative_only"),
        F.count(F.when((F.col("b") == 1) & (F.col("c") == 0), 1)).alias("balanced_only"),
        F.count(F.when((F.col("a") == 1) & (F.col("b") == 0), 1)).alias("aggressive_only"))


def boundary_zone(flags: DataFrame, balanced_table: DataFrame) -> DataFrame:
    """Balanced-decision rows of customers in some but not all ACT sets."""
    ids = flags.where(F.col("n").isin(1, 2)).select("customer_id")
    return (balanced_table.join(ids, "customer_id", "left_semi").select(*BOUNDARY_COLS)
            .orderBy(F.col("net_retention_value").desc(), "customer_id"))


def _three_packs(scored, budget, max_customers, strategy, save_rate):
    scores = D.apply_decision_strategy(D.build_retention_scores(scored, save_rate), strategy)
    scores = scores.withColumn("efficiency", D.efficiency_col())
    elig = scores.where(D.eligible(scores))
    caps = {"base": max_customers, "budget": max_customers, "cap": max(1, int(max_customers * 0.9)) if max_customers else None}
    packs = greedy_pack_many(dict.fromkeys(caps, elig), [("adjusted_priority", True)],
                             {"base": budget, "budget": budget * 0.9, "cap": budget}, caps)
    for pack in packs.values():
        pack.eligible = D.eligible(scores)
    return scores, packs["base"], packs["budget"], packs["cap"]


def decision_stability(scored: DataFrame, budget: float, max_customers: int | None,
                       strategy: str = C.DEFAULT_STRATEGY, save_rate: float = C.SAVE_RATE) -> DataFrame:
    """Share of the base ACT set kept at 90 % budget and at 90 % capacity
    (capacity floor 1). Empty base -> 0.0 and a note."""
    scores, base, rb, rc = _three_packs(scored, budget, max_customers, strategy, save_rate)
    agg = scores.agg(F.count(F.when(base.predicate, 1)).alias("base_count"),
                     F.count(F.when(base.predicate & rb.predicate, 1)).alias("kept_budget"),
                     F.count(F.when(base.predicate & rc.predicate, 1)).alias("kept_capacity"))
    empty = F.col("base_count") == 0
    return agg.select(
        "base_count",
        F.when(empty, F.lit(0.0)).otherwise(fixed(F.col("kept_budget") / F.col("base_count"), 6))
        .alias("budget_stability"),
        F.when(empty, F.lit(0.0)).otherwise(fixed(F.col("kept_capacity") / F.col("base_count"), 6))
        .alias("capacity_stability"),
        F.when(empty, F.lit("No ACT customers under current constraints")).alias("note"))


def stability_attribution(scored: DataFrame, budget: float, max_customers: int | None,
                          strategy: str = C.DEFAULT_STRATEGY, save_rate: float = C.SAVE_RATE) -> DataFrame:
    """Mean churn probability, CLV and efficiency of the rows dropped at 90 %
    budget vs the rows kept there. No row when nothing is dropped."""
    scores, base, rb, _ = _three_packs(scored, budget, max_customers, strategy, save_rate)
    dropped = base.predicate & ~rb.predicate
    kept = rb.predicate

    def mean(cond, col):
        return fixed(F.avg(F.when(cond, F.col(col))), 6)

    return (scores.agg(F.count(F.when(dropped, 1)).alias("dropped_count"),
                       mean(dropped, "churn_probability").alias("dropped_avg_churn"),
                       mean(kept, "churn_probability").alias("retained_avg_churn"),
                       mean(dropped, "CLV").alias("dropped_avg_clv"),
                       mean(kept, "CLV").alias("retained_avg_clv"),
                       mean(dropped, "efficiency").alias("dropped_avg_efficiency"),
                       mean(kept, "efficiency").alias("retained_avg_efficiency"))
            .where(F.col("dropped_count") > 0))
