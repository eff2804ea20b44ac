"""Registry of named queries (``name -> (spark, sf_dir) -> DataFrame``) and their
DuckDB oracles (``name -> SQL``).

Queries without an oracle (model fitting, iterative solvers, streaming) are
checked row-count-only by the driver and by property tests in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions.columns import fixed
from churnlens.operators import summaries as S
from churnlens.operators.survival import km_curve, km_remaining
from churnlens.plans import base as B
from churnlens.plans import oracle as O
from churnlens.sources.quality import dq_violations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---- step 1-2: account view, quality gate, descriptive aggregations -----------

@query("churn_summary", O.base("""
SELECT plan, segment, count(*) AS customers, {cr} AS churn_rate, {mrr} AS avg_mrr, {clv} AS avg_clv
FROM econ GROUP BY plan, segment ORDER BY churn_rate DESC, plan, segment""".format(
    cr=O.fx("avg(churned)", 3),
    mrr=O.fx(f"CAST(sum(CAST(floor(MRR * {O.dbl(100.0)} + {O.dbl(0.5)}) AS BIGINT)) AS DOUBLE) / count(*) / {O.dbl(100.0)}", 2),
    clv=O.fx(f"CAST(sum(CAST(floor(CLV * {O.dbl(1e4)} + {O.dbl(0.5)}) AS BIGINT)) AS DOUBLE) / count(*) / {O.dbl(1e4)}", 2))))
def q_churn_summary(spark, sf_dir):
    """Churn summary by plan and segment (the flagship query)."""
    return S.churn_summary(B.economics(spark, sf_dir))


_DQ_SQL = O.with_ctes(O.ACCOUNT_CTES + [
    ("per_id", f"""
SELECT customer_id, count(*) AS n,
  sum(CASE WHEN coalesce(tenure >= 0 AND tenure <= 100, false) THEN 0 ELSE 1 END) AS tenure_in_0_100,
  sum(CASE WHEN coalesce(MonthlyCharges > 0, false) THEN 0 ELSE 1 END) AS monthly_charges_gt_0,
  sum(CASE WHEN coalesce(TotalCharges >= 0, false) THEN 0 ELSE 1 END) AS total_charges_ge_0,
  sum(CASE WHEN coalesce(Contract IN ('Month-to-month', 'One year', 'Two year'), false) THEN 0 ELSE 1 END) AS contract_in_plans,
  sum(CASE WHEN coalesce(churned IN (0, 1), false) THEN 0 ELSE 1 END) AS churned_in_0_1
FROM acct GROUP BY customer_id"""),
    ("tot", """
SELECT coalesce(sum(n), 0) AS rows_,
  coalesce(sum(CASE WHEN customer_id IS NULL THEN n END), 0) AS customer_id_not_null,
  coalesce(sum(CASE WHEN customer_id IS NOT NULL AND n > 1 THEN n END), 0) AS customer_id_unique,
  coalesce(sum(tenure_in_0_100), 0) AS tenure_in_0_100, coalesce(sum(monthly_charges_gt_0), 0) AS monthly_charges_gt_0,
  coalesce(sum(total_charges_ge_0), 0) AS total_charges_ge_0, coalesce(sum(contract_in_plans), 0) AS contract_in_plans,
  coalesce(sum(churned_in_0_1), 0) AS churned_in_0_1 FROM per_id"""),
], " UNION ALL ".join(
    f"SELECT '{r}' AS rule, CAST({e} AS BIGINT) AS violations FROM tot" for r, e in [
        ("non_empty", "CASE WHEN rows_ = 0 THEN 1 ELSE 0 END"),
        ("customer_id_not_null", "customer_id_not_null"), ("customer_id_unique", "customer_id_unique"),
        ("tenure_in_0_100", "tenure_in_0_100"), ("monthly_charges_gt_0", "monthly_charges_gt_0"),
        ("total_charges_ge_0", "total_charges_ge_0"), ("contract_in_plans", "contract_in_plans"),
        ("churned_in_0_1", "churned_in_0_1")]))


@query("dq_violations", _DQ_SQL)
def q_dq_violations(spark, sf_dir):
    """Declarative data-quality gate: violations per rule on the account table."""
    return dq_violations(B.accounts(spark, sf_dir))


@query("churn_balance", O.base(f"""
SELECT churned, count(*) AS customers, {O.fx("count(*) / (SELECT count(*) FROM econ)", 4)} AS share
FROM econ GROUP BY churned"""))
def q_churn_balance(spark, sf_dir):
    return S.churn_balance(B.economics(spark, sf_dir))


@query("churn_overall", O.base(f"SELECT count(*) AS n, {O.fx('avg(churned)', 4)} AS churn_rate FROM econ"))
def q_churn_overall(spark, sf_dir):
    return S.churn_overall(B.economics(spark, sf_dir))


@query("churn_by_plan", O.base(f"""
SELECT plan, count(*) AS customers, {O.fx('avg(churned)', 4)} AS churn_rate FROM econ
GROUP BY plan ORDER BY churn_rate DESC, plan"""))
def q_churn_by_plan(spark, sf_dir):
    return S.churn_by(B.economics(spark, sf_dir), "plan")


_BUCKET_SQL = ("CASE WHEN tenure >= 0 AND tenure <= 6 THEN '0-6' WHEN tenure > 6 AND tenure <= 12 THEN '7-12' "
               "WHEN tenure > 12 AND tenure <= 24 THEN '13-24' WHEN tenure > 24 AND tenure <= 48 THEN '25-48' "
               "WHEN tenure > 48 AND tenure <= 72 THEN '49-72' END")


@query("churn_by_tenure_bucket", O.base(f"""
SELECT tenure_bucket, count(*) AS customers, {O.fx('avg(churned)', 4)} AS churn_rate
FROM (SELECT *, {_BUCKET_SQL} AS tenure_bucket FROM econ) WHERE tenure_bucket IS NOT NULL
GROUP BY tenure_bucket"""))
def q_churn_by_tenure_bucket(spark, sf_dir):
    return S.churn_by_tenure_bucket(B.economics(spark, sf_dir))


@query("churn_by_attribute", O.base(" UNION ALL ".join(
    f"SELECT '{c}' AS attribute, CAST({c} AS VARCHAR) AS value, count(*) AS customers, "
    f"{O.fx('avg(churned)', 4)} AS churn_rate FROM econ WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in S.ATTRIBUTE_COLUMNS)))
def q_churn_by_attribute(spark, sf_dir):
    return S.churn_by_attribute(B.economics(spark, sf_dir))


@query("plan_economics", O.base("""
SELECT plan, count(*) AS customers, {cr} AS churn_rate, {mrr} AS avg_mrr, {clv} AS avg_clv,
       {spread} AS retention_cost_spread FROM econ GROUP BY plan""".format(
    cr=O.fx("avg(churned)", 2),
    mrr=O.fx(f"CAST(sum(CAST(floor(MRR * {O.dbl(100.0)} + {O.dbl(0.5)}) AS BIGINT)) AS DOUBLE) / count(*) / {O.dbl(100.0)}", 2),
    clv=O.fx(f"CAST(sum(CAST(floor(CLV * {O.dbl(1e4)} + {O.dbl(0.5)}) AS BIGINT)) AS DOUBLE) / count(*) / {O.dbl(1e4)}", 2),
    spread=O.fx("max(retention_cost) - min(retention_cost)", 2))))
def q_plan_economics(spark, sf_dir):
    return S.plan_economics(B.economics(spark, sf_dir))


@query("charge_histogram", O.base(f"""
SELECT g.churned, g.bin, {O.fx("g.lo + g.bin * ((g.hi - g.lo) / " + O.dbl(30.0) + ")", 4)} AS bin_lo,
       {O.fx("g.lo + (g.bin + 1) * ((g.hi - g.lo) / " + O.dbl(30.0) + ")", 4)} AS bin_hi,
       coalesce(c.customers, 0) AS customers,
       {O.fx("coalesce(c.customers, 0) / (g.n * ((g.hi - g.lo) / " + O.dbl(30.0) + "))", 6)} AS density
FROM (SELECT churned, lo, hi, n, unnest(range(0, 30)) AS bin FROM rng) g
LEFT JOIN (SELECT e.churned, CAST(least(29, floor((e.MonthlyCharges - r.lo) * {O.dbl(30.0)} / (r.hi - r.lo))) AS INTEGER) AS bin,
                  count(*) AS customers
           FROM econ e JOIN rng r ON e.churned = r.churned GROUP BY 1, 2) c
  ON c.churned = g.churned AND c.bin = g.bin""", extra=[("rng", f"""
SELECT churned, CASE WHEN max(MonthlyCharges) > min(MonthlyCharges) THEN min(MonthlyCharges) ELSE min(MonthlyCharges) - {O.dbl(0.5)} END AS lo,
       CASE WHEN max(MonthlyCharges) > min(MonthlyCharges) THEN max(MonthlyCharges) ELSE max(MonthlyCharges) + {O.dbl(0.5)} END AS hi,
       count(*) AS n FROM econ GROUP BY churned""")]))
def q_charge_histogram(spark, sf_dir):
    return S.charge_histogram(B.economics(spark, sf_dir))


# ---- step 3: survival and economics ------------------------------------------

@query("km_curve", O.base(f"""
SELECT plan, t, n_at_time, deaths, at_risk, {O.fx('surv', 8)} AS surv FROM km"""))
def q_km_curve(spark, sf_dir):
    """Kaplan–Meier curve per plan at every distinct tenure."""
    c = km_curve(B.scored(spark, sf_dir))
    return c.select("plan", "t", "n_at_time", "deaths", "at_risk", fixed("surv", 8).alias("surv"))


@query("km_remaining", O.base(f"""
SELECT plan, tenure, {O.fx('surv', 8)} AS surv, expected_months FROM km_rem"""))
def q_km_remaining(spark, sf_dir):
    """Restricted mean residual life per plan on the dense tenure grid."""
    c = km_curve(B.scored(spark, sf_dir))
    r = km_remaining(c, "plan")
    return r.select("plan", "tenure", fixed("surv", 8).alias("surv"), "expected_months")


_ECON_COLS = ["customer_id", "plan", "segment", "region", "tenure", "MonthlyCharges", "TotalCharges",
              "churned", "MRR", "expected_months", "CLV", "retention_cost"]


@query("account_economics", O.base(f"SELECT {', '.join(_ECON_COLS)} FROM econ"))
def q_account_economics(spark, sf_dir):
    """Per-account plan, MRR, KM expected months, CLV and retention cost."""
    return B.economics(spark, sf_dir).select(*_ECON_COLS)


_SCORED_COLS = _ECON_COLS + ["churn_probability", "risk_band", "loss_if_act", "loss_if_ignore"]


@query("scored_accounts", O.base(f"SELECT {', '.join(_SCORED_COLS)} FROM scored"))
def q_scored_accounts(spark, sf_dir):
    """Scored table: probability, risk band and diagnostic losses."""
    return B.scored(spark, sf_dir).select(*_SCORED_COLS)

