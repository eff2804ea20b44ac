"""DuckDB SQL oracles for the registered queries.

Each oracle recomputes a query from the raw tables in plain SQL (views ``orders,
customer, nation, region`` …), independently of the Spark code path. Rounding is
spelled as ``floor(x * 10^d + 0.5) / 10^d`` on both sides so both engines return
the same doubles; money sums use integer units.
"""

from __future__ import annotations

from churnlens import config as C


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def fx(expr: str, digits: int) -> str:
    scale = dbl(float(10 ** digits))
    return f"(floor(({expr}) * {scale} + {dbl(0.5)}) / {scale})"


def case_map(col: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {col} = '{k}' THEN {dbl(v) if isinstance(v, float) else v}"
                     for k, v in mapping.items())
    return f"(CASE {whens} ELSE {default} END)"


def risk_band_sql(p: str) -> str:
    return (f"(CASE WHEN {p} >= {dbl(C.RISK_HIGH)} THEN 'HIGH' "
            f"WHEN {p} >= {dbl(C.RISK_MEDIUM)} THEN 'MEDIUM' ELSE 'LOW' END)")


def md5_u32(s: str) -> str:
    return f"CAST(('0x' || substr(md5({s}), 1, 8)) AS BIGINT)"


H = C.CLV_HORIZON_MONTHS

ACCOUNT_CTES = [
    ("o_hist", f"""
SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order,
       count(*) AS n_orders,
       CAST(sum(CAST(floor(o_totalprice * {dbl(100.0)} + {dbl(0.5)}) AS BIGINT)) AS BIGINT) AS spend_cents,
       (SELECT max(o_orderdate) FROM orders) AS as_of
FROM orders GROUP BY o_custkey"""),
    ("acct", f"""
SELECT 'C-' || CAST(c.c_custkey AS VARCHAR) AS customer_id,
       CASE WHEN h.n_orders <= 8 THEN 'Month-to-month' WHEN h.n_orders <= 12 THEN 'One year'
            ELSE 'Two year' END AS Contract,
       c.c_mktsegment AS segment, r.r_name AS region,
       CAST(floor(datediff('day', h.first_order,
            CASE WHEN h.last_order < h.as_of - INTERVAL {C.CHURN_GAP_DAYS} DAY THEN h.last_order
                 ELSE h.as_of END) / 30) AS INTEGER) AS tenure,
       floor(CAST(h.spend_cents AS DOUBLE) / (h.n_orders * 2500) + {dbl(0.5)}) / {dbl(100.0)} AS MonthlyCharges,
       floor(CAST(h.spend_cents AS DOUBLE) / 2500 + {dbl(0.5)}) / {dbl(100.0)} AS TotalCharges,
       CASE WHEN h.last_order < h.as_of - INTERVAL {C.CHURN_GAP_DAYS} DAY THEN 1 ELSE 0 END AS churned,
       h.last_order, h.as_of
FROM customer c JOIN o_hist h ON c.c_custkey = h.o_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""),
]

KM_CTES = [
    ("km_t", """
SELECT Contract AS plan, tenure AS t, count(*) AS n_at_time, CAST(sum(churned) AS BIGINT) AS deaths
FROM acct GROUP BY Contract, tenure"""),
    ("km_r", """
SELECT *, CAST(sum(n_at_time) OVER (PARTITION BY plan ORDER BY t DESC
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS at_risk FROM km_t"""),
    ("km", f"""
SELECT *, product({dbl(1.0)} - CAST(deaths AS DOUBLE) / CAST(at_risk AS DOUBLE)) OVER (
       PARTITION BY plan ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS surv FROM km_r"""),
    ("km_grid", f"""
SELECT plan, unnest(range(0, max(t) + {H + 1})) AS tenure FROM km GROUP BY plan"""),
    ("km_step", f"""
SELECT g.plan, g.tenure, coalesce(last_value(k.surv IGNORE NULLS) OVER (PARTITION BY g.plan ORDER BY g.tenure
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {dbl(1.0)}) AS surv
FROM km_grid g LEFT JOIN km k ON k.plan = g.plan AND k.t = g.tenure"""),
    ("km_rem", f"""
SELECT plan, tenure, surv, {fx(f"CASE WHEN surv <= {dbl(1e-9)} THEN {dbl(0.0)} ELSE sum(surv) OVER (PARTITION BY plan ORDER BY tenure ROWS BETWEEN 1 FOLLOWING AND {H} FOLLOWING) / surv END", 6)} AS expected_months
FROM km_step"""),
]

_OUTREACH = case_map("a.Contract", C.OUTREACH_COST)
_PLAN_W = case_map("plan", C.SCORECARD_PLAN)

ECON_CTES = [
    ("econ", f"""
SELECT a.*, a.Contract AS plan, a.MonthlyCharges AS MRR, r.expected_months,
       {fx("a.MonthlyCharges * r.expected_months", 4)} AS CLV,
       {fx(f"{_OUTREACH} + {dbl(C.DISCOUNT_RATE)} * a.MonthlyCharges * {dbl(float(C.OFFER_MONTHS))}", 4)} AS retention_cost
FROM acct a LEFT JOIN km_rem r ON r.plan = a.Contract AND r.tenure = a.tenure"""),
    ("scored0", f"""
SELECT *, {fx(f"{dbl(1.0)} / ({dbl(1.0)} + exp(-({dbl(C.SCORECARD_INTERCEPT)} + {dbl(C.SCORECARD_TENURE)} * tenure + {dbl(C.SCORECARD_CHARGE)} * MonthlyCharges + {_PLAN_W})))", 6)} AS churn_probability
FROM econ"""),
    ("scored", f"""
SELECT *, {risk_band_sql("churn_probability")} AS risk_band,
       {fx(f"({dbl(1.0)} - churn_probability) * retention_cost", 4)} AS loss_if_act,
       {fx("churn_probability * CLV", 4)} AS loss_if_ignore
FROM scored0"""),
]

BASE = ACCOUNT_CTES + KM_CTES + ECON_CTES


def with_ctes(ctes, body: str, recursive: bool = False) -> str:
    parts = ",\n".join(f"{name} AS ({sql.strip()})" for name, sql in ctes)
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{body.strip()}"


def base(body: str, extra=()) -> str:
    return with_ctes(list(BASE) + list(extra), body)
