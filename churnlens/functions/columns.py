"""Scalar column expressions shared by the operators.

All expressions are built-in ``pyspark.sql.functions`` so they stay inside
whole-stage codegen; none needs a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnlens import config as C


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed(c, digits: int) -> Column:
    """Round half-up at ``digits`` decimals as ``floor(x * 10^d + 0.5) / 10^d``.

    Spelled out with IEEE operations so that any engine evaluating the same
    expression returns the same double (built-in ``round`` implementations differ
    on ties between engines). NaN has no rounded value and becomes NULL.
    """
    scale = float(10 ** digits)
    rounded = F.floor(col_(c) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
    return F.when(~F.isnan(col_(c)), rounded)


def cents(c) -> Column:
    """Money with two decimals as exact integer cents."""
    return F.floor(col_(c) * F.lit(100.0) + F.lit(0.5)).cast("bigint")


def micro(c) -> Column:
    """Money as integer micro-units (1e-4) for exact, order-free sums."""
    return F.floor(col_(c) * F.lit(float(C.MICRO)) + F.lit(0.5)).cast("bigint")


def exact_avg(c, digits: int) -> Column:
    """Average of a column that carries at most ``digits`` decimals, summed as
    integers so the result does not depend on partitioning."""
    scale = float(10 ** digits)
    scaled = F.floor(col_(c) * F.lit(scale) + F.lit(0.5)).cast("bigint")
    return F.sum(scaled).cast("double") / F.count(scaled) / F.lit(scale)


def hash_u32(*parts) -> Column:
    """Deterministic 32-bit draw from ``md5`` of the concatenated parts.

    Same value at any parallelism, and expressible in plain SQL
    (``('0x' || substr(md5(s), 1, 8))::BIGINT``).
    """
    s = F.concat(*[F.lit(p) if not isinstance(p, Column) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def hash_uniform(*parts) -> Column:
    """Uniform draw in [0, 1) from ``hash_u32``."""
    return hash_u32(*parts).cast("double") / F.lit(4294967296.0)


def risk_band(p) -> Column:
    p = col_(p)
    return (F.when(p >= F.lit(C.RISK_HIGH), "HIGH")
            .when(p >= F.lit(C.RISK_MEDIUM), "MEDIUM")
            .otherwise("LOW"))


def outreach_cost(plan) -> Column:
    plan = col_(plan)
    expr = None
    for name, cost in C.OUTREACH_COST.items():
        expr = (F.when(plan == name, F.lit(cost)) if expr is None
                else expr.when(plan == name, F.lit(cost)))
    return expr  # unmapped plan -> NULL


def retention_cost(plan, mrr) -> Column:
    """Outreach cost by plan plus the win-back discount ``rate * MRR * months``."""
    return fixed(outreach_cost(plan)
                 + F.lit(C.DISCOUNT_RATE) * col_(mrr) * F.lit(float(C.OFFER_MONTHS)), 4)


def scorecard_probability(tenure, charge, plan) -> Column:
    """Fixed logistic scorecard (stand-in scorer; see ``config``)."""
    plan = col_(plan)
    plan_term = None
    for name, w in C.SCORECARD_PLAN.items():
        plan_term = (F.when(plan == name, F.lit(w)) if plan_term is None
                     else plan_term.when(plan == name, F.lit(w)))
    logit = (F.lit(C.SCORECARD_INTERCEPT) + F.lit(C.SCORECARD_TENURE) * col_(tenure)
             + F.lit(C.SCORECARD_CHARGE) * col_(charge) + plan_term)
    return fixed(F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)), 6)


def tenure_bucket(tenure) -> Column:
    """Right-closed bins with the lowest edge included; outside -> NULL."""
    t = col_(tenure)
    expr = None
    for lo, hi, label in C.TENURE_BUCKETS:
        cond = (t >= lo) & (t <= hi) if lo == 0 else (t > lo) & (t <= hi)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def strategy_weight(band, strategy: str) -> Column:
    key = strategy.lower()
    if key not in C.STRATEGY_WEIGHTS:
        raise ValueError(f"Unknown strategy: {strategy}")
    w = C.STRATEGY_WEIGHTS[key]
    band = col_(band)
    return (F.when(band == "HIGH", F.lit(w["HIGH"]))
            .when(band == "MEDIUM", F.lit(w["MEDIUM"]))
            .when(band == "LOW", F.lit(w["LOW"])))
