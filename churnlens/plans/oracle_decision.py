"""SQL oracle for decisions: the greedy walk as a sequential recursive CTE.

``decision_ctes(scenarios)`` yields CTEs over ``scored`` (see ``oracle.BASE``):

* ``dp``     scenario parameters
* ``ds``     per (scenario, customer): revenue_at_risk, net value, priority, weight,
             adjusted_priority, cost in micro-units
* ``de``     eligible rows numbered in walk order per scenario
* ``dw``     the row-by-row skip-and-continue walk (recursive)
* ``dsel``   selected (scenario, customer_id); ``dspent`` budget used
* ``dfinal`` every row with action_segment, efficiency, reason, action
"""

from __future__ import annotations

from dataclasses import dataclass

from churnlens import config as C
from churnlens.plans.oracle import BASE, dbl, fx, with_ctes

NO_CAP = 10 ** 15


@dataclass(frozen=True)
class Scenario:
    name: str
    budget: float = C.DEFAULT_BUDGET
    max_customers: int | None = C.DEFAULT_MAX_CUSTOMERS
    strategy: str = C.DEFAULT_STRATEGY
    save_rate: float = C.SAVE_RATE


def _weight_sql() -> str:
    whens = []
    for strat, w in C.STRATEGY_WEIGHTS.items():
        for band, v in w.items():
            whens.append(f"WHEN strategy = '{strat}' AND risk_band = '{band}' THEN {dbl(v)}")
    return f"(CASE {' '.join(whens)} END)"


def decision_ctes(scenarios: list[Scenario], order: str = "adjusted_priority",
                  source: str = "scored") -> list[tuple[str, str]]:
    rows = ", ".join(
        f"('{s.name}', CAST({int(round(s.budget * C.MICRO))} AS BIGINT), "
        f"CAST({s.max_customers or NO_CAP} AS BIGINT), '{s.strategy.lower()}', {dbl(float(s.save_rate))})"
        for s in scenarios)
    micro = f"CAST(floor(retention_cost * {dbl(float(C.MICRO))} + {dbl(0.5)}) AS BIGINT)"
    return [
        ("dp", f"SELECT * FROM (VALUES {rows}) AS t(scenario, budget_micro, cap, strategy, save_rate)"),
        ("ds0", f"""
SELECT p.scenario, p.strategy, p.save_rate, s.*, {fx("s.churn_probability * s.CLV", 4)} AS revenue_at_risk
FROM {source} s CROSS JOIN dp p"""),
        ("ds1", f"SELECT *, {fx('save_rate * revenue_at_risk - retention_cost', 4)} AS net_retention_value FROM ds0"),
        ("ds2", f"""
SELECT *, greatest(net_retention_value, {dbl(0.0)}) AS retention_priority_score,
       {_weight_sql()} AS strategy_weight FROM ds1"""),
        ("ds", f"""
SELECT *, {fx('retention_priority_score * strategy_weight', 6)} AS adjusted_priority,
       {micro} AS cost_micro,
       CASE WHEN retention_cost > 0 THEN {fx('net_retention_value / retention_cost', 6)} END AS efficiency
FROM ds2"""),
        ("de", f"""
SELECT scenario, customer_id, cost_micro,
       row_number() OVER (PARTITION BY scenario ORDER BY {order} DESC, customer_id) AS rn
FROM ds WHERE retention_cost > 0 AND net_retention_value > 0"""),
        *walk_ctes("d", "de", "dp"),
        ("dq", f"""
SELECT quantile_cont(CLV, 0.5) AS clv_median, quantile_cont(retention_cost, 0.5) AS cost_median,
       quantile_cont(CLV, 0.75) AS clv_q75 FROM {source}"""),
        ("dseg", """
SELECT d.*, CASE WHEN s.customer_id IS NOT NULL THEN 'ACT' WHEN d.net_retention_value > 0 THEN 'MONITOR'
                 ELSE 'IGNORE' END AS action_segment
FROM ds d LEFT JOIN dsel s ON s.scenario = d.scenario AND s.customer_id = d.customer_id"""),
        ("dfinal", f"""
SELECT d.*,
  CASE WHEN action_segment = 'ACT' THEN array_to_string(list_slice(list_filter([
      CASE WHEN risk_band = 'HIGH' THEN '{C.REASON_HIGH}' WHEN risk_band = 'MEDIUM' THEN '{C.REASON_MEDIUM}' END,
      CASE WHEN CLV >= q.clv_median THEN '{C.REASON_VALUE}' END,
      CASE WHEN retention_cost <= q.cost_median THEN '{C.REASON_COST}' END,
      CASE WHEN plan = 'Month-to-month' THEN '{C.REASON_NO_CONTRACT}' END,
      CASE WHEN tenure <= 6 THEN '{C.REASON_NEW}' END], lambda x: x IS NOT NULL), 1, 3), ' + ')
    ELSE '' END AS decision_reason,
  CASE WHEN action_segment = 'ACT' THEN
    CASE WHEN risk_band = 'HIGH' AND CLV >= q.clv_q75 THEN '{C.ACTION_PREMIUM}'
         WHEN risk_band = 'HIGH' THEN '{C.ACTION_DISCOUNT}'
         WHEN risk_band = 'MEDIUM' THEN '{C.ACTION_EMAIL}' ELSE '{C.ACTION_STANDARD}' END
    ELSE '' END AS recommended_action
FROM dseg d CROSS JOIN dq q"""),
    ]


def walk_ctes(prefix: str, elig: str, params: str) -> list[tuple[str, str]]:
    """Sequential skip-and-continue walk over ``elig(scenario, customer_id,
    cost_micro, rn)`` with ``params(scenario, budget_micro, cap)``; yields
    ``{prefix}w`` (walk), ``{prefix}sel`` (selected ids), ``{prefix}spent``."""
    w = f"{prefix}w"
    return [
        (w, f"""
SELECT scenario, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS spent, CAST(0 AS BIGINT) AS n, false AS taken
FROM {params}
UNION ALL
SELECT w.scenario, e.rn,
       CASE WHEN w.spent + e.cost_micro <= p.budget_micro THEN w.spent + e.cost_micro ELSE w.spent END,
       CASE WHEN w.spent + e.cost_micro <= p.budget_micro THEN w.n + 1 ELSE w.n END,
       w.spent + e.cost_micro <= p.budget_micro
FROM {w} w JOIN {elig} e ON e.scenario = w.scenario AND e.rn = w.rn + 1
JOIN {params} p ON p.scenario = w.scenario
WHERE w.n < p.cap"""),
        (f"{prefix}sel", f"""
SELECT e.scenario, e.customer_id FROM {w} w JOIN {elig} e ON e.scenario = w.scenario AND e.rn = w.rn
WHERE w.taken"""),
        (f"{prefix}spent", f"""
SELECT p.scenario, coalesce(max(w.spent), 0) / {dbl(float(C.MICRO))} AS spent
FROM {params} p LEFT JOIN {w} w ON w.scenario = p.scenario GROUP BY p.scenario"""),
    ]


def decision_sql(body: str, scenarios: list[Scenario], extra=(), **kw) -> str:
    return with_ctes(list(BASE) + decision_ctes(scenarios, **kw) + list(extra), body, recursive=True)


DEFAULT = [Scenario("base")]
