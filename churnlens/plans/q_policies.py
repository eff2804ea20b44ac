"""Registered queries: policy baselines, sensitivity, strategy sets, stability,
optimality bound and outcome simulation."""

from __future__ import annotations

from churnlens import config as C
from churnlens.operators import decision as D
from churnlens.operators import policies as P
from churnlens.operators import robustness as R
from churnlens.operators.simulation import DENSITY_SCALE, beta_parameters, simulate_outcomes
from churnlens.plans import base as B
from churnlens.plans.oracle import dbl, fx, md5_u32
from churnlens.plans.oracle_decision import DEFAULT, Scenario, decision_sql, walk_ctes
from churnlens.plans.registry import query

BUDGET, CAP, STRAT, RATE = C.DEFAULT_BUDGET, C.DEFAULT_MAX_CUSTOMERS, C.DEFAULT_STRATEGY, C.SAVE_RATE
MICRO = dbl(float(C.MICRO))


def _money_sql(expr_micro: str) -> str:
    return f"(coalesce(sum({expr_micro}), 0) / {MICRO})"


def net_micro(alias: str = "") -> str:
    return f"CAST(floor({alias}net_retention_value * {MICRO} + {dbl(0.5)}) AS BIGINT)"


NET_MICRO = net_micro()
RAR_MICRO = f"CAST(floor(revenue_at_risk * {MICRO} + {dbl(0.5)}) AS BIGINT)"

# ---- K5 / K6 policy comparison --------------------------------------------------

_POLICY_CTES = [
    ("pp", "SELECT * FROM (VALUES " + ", ".join(
        f"('{n}', CAST({int(round(BUDGET * C.MICRO))} AS BIGINT), CAST({CAP} AS BIGINT))"
        for n in P.NAIVE_POLICIES + [P.ENGINE_POLICY]) + ") AS t(scenario, budget_micro, cap)"),
    ("pb", f"SELECT *, {md5_u32(f"'{C.SEED}' || customer_id")} AS random_key "
           "FROM ds WHERE scenario = 'base' AND retention_cost > 0"),
    ("pe", """
SELECT 'Random' AS scenario, customer_id, cost_micro, row_number() OVER (ORDER BY random_key, customer_id) AS rn FROM pb
UNION ALL
SELECT 'Target highest churn', customer_id, cost_micro,
       row_number() OVER (ORDER BY churn_probability DESC, customer_id) FROM pb
UNION ALL
SELECT 'Target highest CLV', customer_id, cost_micro, row_number() OVER (ORDER BY CLV DESC, customer_id) FROM pb
UNION ALL
SELECT 'Decision engine', customer_id, cost_micro,
       row_number() OVER (ORDER BY net_retention_value DESC, customer_id) FROM pb WHERE net_retention_value > 0"""),
    *walk_ctes("p", "pe", "pp"),
    ("ptab", f"""
SELECT pp.scenario AS policy, count(b.customer_id) AS customers,
       {_money_sql('b.cost_micro')} AS cost, {_money_sql(net_micro('b.'))} AS value
FROM pp LEFT JOIN psel s ON s.scenario = pp.scenario LEFT JOIN pb b ON b.customer_id = s.customer_id
GROUP BY pp.scenario"""),
    ("pout", f"""
SELECT policy, customers, {fx('cost', 2)} AS budget_used, {fx('value', 2)} AS expected_value,
       CASE WHEN cost > 0 THEN {fx('value / cost', 4)} ELSE {dbl(0.0)} END AS roi FROM ptab"""),
]


@query("policy_comparison", decision_sql("SELECT * FROM pout", DEFAULT, extra=_POLICY_CTES))
def q_policy_comparison(spark, sf_dir):
    """Engine vs random / highest-churn / highest-CLV targeting under the same budget and cap."""
    return P.compare_policies(B.scored(spark, sf_dir), BUDGET, CAP, RATE)


@query("policy_lift", decision_sql(f"""
SELECT first(policy ORDER BY expected_value DESC, policy DESC) AS best_naive_policy,
       max(expected_value) AS best_naive_value,
       (SELECT max(expected_value) FROM pout WHERE policy = 'Decision engine') AS engine_value,
       {fx("((SELECT max(expected_value) FROM pout WHERE policy = 'Decision engine') - max(expected_value)) / greatest(max(expected_value), " + dbl(1.0) + ") * " + dbl(100.0), 4)} AS lift_pct
FROM pout WHERE policy <> 'Decision engine'""", DEFAULT, extra=_POLICY_CTES))
def q_policy_lift(spark, sf_dir):
    """Value lift of the engine over the best naive policy (%)."""
    return P.policy_lift(P.compare_policies(B.scored(spark, sf_dir), BUDGET, CAP, RATE))


# ---- K8 / K9 / E10 -----------------------------------------------------------------

_ACT_TOT = f"""
SELECT count(*) AS act_count, {_money_sql('cost_micro')} AS act_cost, {_money_sql(NET_MICRO)} AS act_net,
       {_money_sql(RAR_MICRO)} AS act_rar FROM dfinal WHERE scenario = 'base' AND action_segment = 'ACT'"""


@query("save_rate_sensitivity", decision_sql(f"""
SELECT rate, {fx('rate * act_rar - act_cost', 2)} AS net_value,
       {fx(f'CASE WHEN act_rar <> 0 THEN act_cost / act_rar END', 6)} AS break_even,
       {dbl(RATE)} AS assumed,
       {fx(f'{dbl(RATE)} - CASE WHEN act_rar <> 0 THEN act_cost / act_rar END', 6)} AS margin_of_safety,
       {fx('act_rar', 4)} AS revenue_at_risk, {fx('act_cost', 4)} AS cost
FROM (SELECT *, {fx(f'k * {dbl(1.0 / 20)}', 2)} AS rate FROM atot CROSS JOIN (SELECT unnest(range(0, 21)) AS k))""",
    DEFAULT, extra=[("atot", _ACT_TOT)]))
def q_save_rate_sensitivity(spark, sf_dir):
    """Break-even save rate and net value of the funded set at true rates 0..1."""
    dec = B.decision(spark, sf_dir, D.DecisionParams(BUDGET, CAP, STRAT, RATE))
    return P.save_rate_sensitivity(dec.funded, RATE)


_SWEEP = [round(0.1 * i, 2) for i in range(1, 11)]


@query("roi_sweep", decision_sql(f"""
SELECT p.save_rate, count(f.customer_id) AS act_count,
       {fx(f"{_money_sql(net_micro('f.'))} / greatest({_money_sql('f.cost_micro')}, {dbl(1.0)})", 6)} AS roi
FROM dp p LEFT JOIN dfinal f ON f.scenario = p.scenario AND f.action_segment = 'ACT'
GROUP BY p.scenario, p.save_rate""", [Scenario(f"r{r}", save_rate=r) for r in _SWEEP]))
def q_roi_sweep(spark, sf_dir):
    """ROI of the ACT set re-decided at save rates 0.1 .. 1.0."""
    return P.roi_sweep(B.scored(spark, sf_dir), BUDGET, CAP, STRAT, _SWEEP, decide_many=B.decider(spark, sf_dir))


@query("strategy_comparison", decision_sql(f"""
SELECT p.scenario AS strategy, count(f.customer_id) AS act_customers,
       {fx(f"avg(CASE WHEN f.risk_band = 'HIGH' THEN {dbl(1.0)} WHEN f.customer_id IS NOT NULL THEN {dbl(0.0)} END) * 100", 4)} AS pct_high,
       {fx(f"avg(CASE WHEN f.risk_band = 'MEDIUM' THEN {dbl(1.0)} WHEN f.customer_id IS NOT NULL THEN {dbl(0.0)} END) * 100", 4)} AS pct_medium,
       {fx(_money_sql(net_micro('f.')), 2)} AS revenue_saved,
       {fx(_money_sql('f.cost_micro'), 2)} AS budget_used,
       {fx(_money_sql(net_micro('f.')) + ' / greatest(' + _money_sql('f.cost_micro') + ', ' + dbl(1.0) + ')', 6)} AS roi
FROM dp p LEFT JOIN dfinal f ON f.scenario = p.scenario AND f.action_segment = 'ACT'
GROUP BY p.scenario""", [Scenario(s, strategy=s) for s in C.STRATEGIES]))
def q_strategy_comparison(spark, sf_dir):
    """ACT count, risk mix, value, cost and ROI per strategy."""
    return P.strategy_comparison(B.scored(spark, sf_dir), BUDGET, CAP, RATE, decide_many=B.decider(spark, sf_dir))


# ---- I1-I5 set operations ------------------------------------------------------------

_SETS = [Scenario(s, strategy=s) for s in C.STRATEGIES]
_FLAGS = [("fl", """
SELECT customer_id, max(CASE WHEN scenario = 'Aggressive' THEN 1 ELSE 0 END) AS a,
       max(CASE WHEN scenario = 'Balanced' THEN 1 ELSE 0 END) AS b,
       max(CASE WHEN scenario = 'Conservative' THEN 1 ELSE 0 END) AS c
FROM dsel GROUP BY customer_id""")]


def _sets(spark, sf_dir):
    sets, decisions = R.strategy_act_sets(B.scored(spark, sf_dir), BUDGET, CAP, RATE,
                                          decide_many=B.decider(spark, sf_dir))
    return R.membership_flags(sets), decisions


@query("counterfactual_sets", decision_sql("""
SELECT 'Aggressive_only' AS set_name, customer_id FROM fl WHERE a = 1 AND b = 0
UNION ALL SELECT 'Balanced_only', customer_id FROM fl WHERE b = 1 AND c = 0
UNION ALL SELECT 'Dropped_in_Conservative', customer_id FROM fl WHERE a = 1 AND c = 0""", _SETS, extra=_FLAGS))
def q_counterfactual_sets(spark, sf_dir):
    """Customers funded under one strategy but not another (A-B, B-C, A-C)."""
    flags, _ = _sets(spark, sf_dir)
    return R.counterfactual_sets(flags)


@query("boundary_sizes", decision_sql("""
SELECT count(*) FILTER (WHERE a + b + c IN (1, 2)) AS dbz_count,
       count(*) FILTER (WHERE c = 1 AND b = 0) AS conservative_only,
       count(*) FILTER (WHERE b = 1 AND c = 0) AS balanced_only,
       count(*) FILTER (WHERE a = 1 AND b = 0) AS aggressive_only FROM fl""", _SETS, extra=_FLAGS))
def q_boundary_sizes(spark, sf_dir):
    """Size of the decision boundary zone and of the one-sided differences."""
    flags, _ = _sets(spark, sf_dir)
    return R.boundary_sizes(flags)


@query("boundary_zone", decision_sql(f"""
SELECT {', '.join(R.BOUNDARY_COLS)} FROM dfinal
WHERE scenario = 'Balanced' AND customer_id IN (SELECT customer_id FROM fl WHERE a + b + c IN (1, 2))""",
    _SETS, extra=_FLAGS))
def q_boundary_zone(spark, sf_dir):
    """Balanced-decision rows of customers funded by some but not all strategies."""
    flags, decisions = _sets(spark, sf_dir)
    return R.boundary_zone(flags, decisions["Balanced"].table)


_STAB = [Scenario("base"), Scenario("budget90", budget=BUDGET * 0.9),
         Scenario("cap90", max_customers=max(1, int(CAP * 0.9)))]
_STAB_FLAGS = [("sf", """
SELECT d.customer_id, d.churn_probability, d.CLV, d.efficiency,
       max(CASE WHEN s.scenario = 'base' THEN 1 ELSE 0 END) AS base,
       max(CASE WHEN s.scenario = 'budget90' THEN 1 ELSE 0 END) AS rb,
       max(CASE WHEN s.scenario = 'cap90' THEN 1 ELSE 0 END) AS rc
FROM ds d LEFT JOIN dsel s ON s.customer_id = d.customer_id AND s.scenario IN ('base', 'budget90', 'cap90')
WHERE d.scenario = 'base'
GROUP BY d.customer_id, d.churn_probability, d.CLV, d.efficiency""")]


@query("decision_stability", decision_sql(f"""
SELECT count(*) FILTER (WHERE base = 1) AS base_count,
       CASE WHEN count(*) FILTER (WHERE base = 1) = 0 THEN {dbl(0.0)}
            ELSE {fx('count(*) FILTER (WHERE base = 1 AND rb = 1) / count(*) FILTER (WHERE base = 1)', 6)} END AS budget_stability,
       CASE WHEN count(*) FILTER (WHERE base = 1) = 0 THEN {dbl(0.0)}
            ELSE {fx('count(*) FILTER (WHERE base = 1 AND rc = 1) / count(*) FILTER (WHERE base = 1)', 6)} END AS capacity_stability,
       CASE WHEN count(*) FILTER (WHERE base = 1) = 0 THEN 'No ACT customers under current constraints' END AS note
FROM sf""", _STAB, extra=_STAB_FLAGS))
def q_decision_stability(spark, sf_dir):
    """Share of ACT decisions kept at 90 % budget and at 90 % capacity."""
    return R.decision_stability(B.scored(spark, sf_dir), BUDGET, CAP, STRAT, RATE)


@query("stability_attribution", decision_sql(f"""
SELECT * FROM (
SELECT count(*) FILTER (WHERE base = 1 AND rb = 0) AS dropped_count,
       {fx('avg(churn_probability) FILTER (WHERE base = 1 AND rb = 0)', 6)} AS dropped_avg_churn,
       {fx('avg(churn_probability) FILTER (WHERE rb = 1)', 6)} AS retained_avg_churn,
       {fx('avg(CLV) FILTER (WHERE base = 1 AND rb = 0)', 6)} AS dropped_avg_clv,
       {fx('avg(CLV) FILTER (WHERE rb = 1)', 6)} AS retained_avg_clv,
       {fx('avg(efficiency) FILTER (WHERE base = 1 AND rb = 0)', 6)} AS dropped_avg_efficiency,
       {fx('avg(efficiency) FILTER (WHERE rb = 1)', 6)} AS retained_avg_efficiency
FROM sf) WHERE dropped_count > 0""", _STAB, extra=_STAB_FLAGS))
def q_stability_attribution(spark, sf_dir):
    """Profile of customers dropped when the budget shrinks 10 % vs those kept."""
    return R.stability_attribution(B.scored(spark, sf_dir), BUDGET, CAP, STRAT, RATE)


# ---- K7 optimality bound -------------------------------------------------------------

def _bound_ctes(cap: int | None) -> list[tuple[str, str]]:
    """Halving on the price of the budget; the best rows up to the cap answer each price."""
    limit = f"WHERE r <= {cap}" if cap else ""
    return [
        ("oe", "SELECT net_retention_value AS v, retention_cost AS c FROM ds WHERE scenario = 'base' AND retention_cost > 0 AND net_retention_value > 0"),
        ("ostep", f"""
SELECT 0 AS step, {dbl(0.0)} AS lo, max(v / c) AS hi FROM oe
UNION ALL
SELECT step + 1, CASE WHEN coalesce(used, 0) > {dbl(float(BUDGET))} THEN (lo + hi) / 2 ELSE lo END,
       CASE WHEN coalesce(used, 0) > {dbl(float(BUDGET))} THEN hi ELSE (lo + hi) / 2 END
FROM (SELECT step, lo, hi, sum(c) AS used FROM (
        SELECT s.step, s.lo, s.hi, oe.c, row_number() OVER (PARTITION BY s.step ORDER BY oe.v - (s.lo + s.hi) / 2 * oe.c DESC) AS r,
               oe.v - (s.lo + s.hi) / 2 * oe.c AS w FROM ostep s CROSS JOIN oe WHERE s.step < 70)
      {limit + ' AND' if limit else 'WHERE'} w > 0 GROUP BY ALL)"""),
        ("oprice", "SELECT unnest([first(lo ORDER BY step DESC), first(hi ORDER BY step DESC)]) AS l FROM ostep"),
        ("obound", f"""
SELECT min(ub) AS ub FROM (
  SELECT l, l * {dbl(float(BUDGET))} + coalesce(sum(w) FILTER (WHERE w > 0), 0) AS ub FROM (
    SELECT l, v - l * c AS w, row_number() OVER (PARTITION BY l ORDER BY v - l * c DESC) AS r FROM oprice CROSS JOIN oe) {limit} GROUP BY l)"""),
        ("obest", "SELECT ceil(round(ub * 100, 6)) / 100 AS ub FROM obound"),
        ("ogreedy", f"""
SELECT count(*) AS greedy_customers, {_money_sql(net_micro('d.'))} AS greedy_value
FROM dsel s JOIN ds d ON d.scenario = s.scenario AND d.customer_id = s.customer_id"""),
    ]


_BOUND_SQL = f"""
SELECT {fx('g.greedy_value', 4)} AS greedy_value, g.greedy_customers, b.ub AS upper_bound,
       CASE WHEN b.ub > 0 THEN {fx(f'g.greedy_value / b.ub * {dbl(100.0)}', 4)} ELSE {dbl(100.0)} END AS capture_pct_lower_bound
FROM ogreedy g CROSS JOIN obest b"""


@query("optimality_bound", decision_sql(_BOUND_SQL, DEFAULT, extra=_bound_ctes(CAP), order="efficiency"))
def q_optimality_bound(spark, sf_dir):
    """Greedy-by-efficiency value vs a dual upper bound on the knapsack optimum."""
    return P.optimality_bound(B.scored(spark, sf_dir), BUDGET, CAP, RATE)


@query("optimality_bound_uncapped", decision_sql(_BOUND_SQL, [Scenario("base", max_customers=None)], extra=_bound_ctes(None), order="efficiency"))
def q_optimality_bound_uncapped(spark, sf_dir):
    """The same without a cap on customers."""
    return P.optimality_bound(B.scored(spark, sf_dir), BUDGET, None, RATE)


# ---- K11 outcome distribution ---------------------------------------------------------

_A, _B = beta_parameters(RATE, C.RATE_STD)
_SIM_CTES = [
    ("sa", "SELECT customer_id, churn_probability, CLV, cost_micro FROM dfinal WHERE action_segment = 'ACT'"),
    ("stc", "SELECT sum(cost_micro) AS total FROM sa"),
    ("sg0", f"""
SELECT i, exp(({dbl(_A)} - 1) * ln((i + {dbl(0.5)}) / {dbl(10000.0)})
            + ({dbl(_B)} - 1) * ln(1 - (i + {dbl(0.5)}) / {dbl(10000.0)})) AS d
FROM (SELECT unnest(range(0, 10000)) AS i)"""),
    ("sg1", f"""
SELECT i, CAST(floor(d / (SELECT max(d) FROM sg0) * {dbl(DENSITY_SCALE)}) AS BIGINT) AS di FROM sg0"""),
    ("sg", """
SELECT i, CAST(sum(di) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
          / CAST((SELECT sum(di) FROM sg1) AS DOUBLE) AS cdf FROM sg1"""),
    ("ssc", f"""
SELECT s AS scenario,
       CAST({md5_u32(f"'{C.SEED}|rate|' || CAST(s AS VARCHAR)")} AS DOUBLE) / {dbl(4294967296.0)} AS u
FROM (SELECT unnest(range(0, {C.N_SIMS})) AS s)"""),
    ("srate", f"""
SELECT scenario, (CAST((SELECT count(*) FROM sg WHERE sg.cdf < ssc.u) AS DOUBLE) + {dbl(0.5)}) / {dbl(10000.0)} AS rate
FROM ssc"""),
    ("sper", f"""
SELECT r.scenario, coalesce(sum(CASE WHEN
   CAST({md5_u32(f"'{C.SEED}|churn|' || CAST(r.scenario AS VARCHAR) || '|' || a.customer_id")} AS DOUBLE) / {dbl(4294967296.0)} < a.churn_probability
   AND CAST({md5_u32(f"'{C.SEED}|save|' || CAST(r.scenario AS VARCHAR) || '|' || a.customer_id")} AS DOUBLE) / {dbl(4294967296.0)} < r.rate
   THEN CAST(floor(a.CLV * {MICRO} + {dbl(0.5)}) AS BIGINT) ELSE 0 END), 0) AS gross
FROM srate r CROSS JOIN sa a GROUP BY r.scenario"""),
    ("snet", f"""
SELECT CAST(gross - (SELECT total FROM stc) AS DOUBLE) / {MICRO} AS net,
       CAST(gross - (SELECT total FROM stc) AS DOUBLE) / CAST((SELECT total FROM stc) AS DOUBLE) AS roi FROM sper"""),
]


@query("outcome_distribution", decision_sql(f"""
SELECT {dbl(RATE)} AS assumed_save_rate, {fx(f'(SELECT total FROM stc) / {MICRO}', 4)} AS cost,
       {fx('avg(net)', 4)} AS net_mean, {fx('quantile_cont(net, 0.05)', 4)} AS net_p5,
       {fx('quantile_cont(net, 0.95)', 4)} AS net_p95, {fx('avg(roi)', 6)} AS roi_mean,
       {fx('quantile_cont(roi, 0.05)', 6)} AS roi_p5, {fx('quantile_cont(roi, 0.95)', 6)} AS roi_p95,
       {fx(f'avg(CASE WHEN net > 0 THEN {dbl(1.0)} ELSE {dbl(0.0)} END)', 6)} AS prob_profitable,
       count(*) AS scenarios
FROM snet HAVING coalesce(max((SELECT total FROM stc)), 0) > 0""", DEFAULT, extra=_SIM_CTES))
def q_outcome_distribution(spark, sf_dir):
    """Monte Carlo distribution of realized net value / ROI of the funded set (3,000 scenarios)."""
    dec = B.decision(spark, sf_dir, D.DecisionParams(BUDGET, CAP, STRAT, RATE))
    act = dec.funded.select("customer_id", "churn_probability", "CLV", "retention_cost")
    return simulate_outcomes(act, RATE)


@query("outcome_histogram", decision_sql(f"""
SELECT g.bin, {fx('r.lo + g.bin * ((r.hi - r.lo) / ' + dbl(44.0) + ')', 6)} AS roi_lo,
       {fx('r.lo + (g.bin + 1) * ((r.hi - r.lo) / ' + dbl(44.0) + ')', 6)} AS roi_hi,
       coalesce(c.scenarios, 0) AS scenarios
FROM (SELECT unnest(range(0, 44)) AS bin) g
CROSS JOIN (SELECT CASE WHEN max(roi) > min(roi) THEN min(roi) ELSE min(roi) - {dbl(0.5)} END AS lo,
                   CASE WHEN max(roi) > min(roi) THEN max(roi) ELSE max(roi) + {dbl(0.5)} END AS hi FROM snet) r
LEFT JOIN (SELECT CAST(least(43, floor((s.roi - r2.lo) * {dbl(44.0)} / (r2.hi - r2.lo))) AS INTEGER) AS bin,
                  count(*) AS scenarios
           FROM snet s CROSS JOIN (SELECT CASE WHEN max(roi) > min(roi) THEN min(roi) ELSE min(roi) - {dbl(0.5)} END AS lo,
                                          CASE WHEN max(roi) > min(roi) THEN max(roi) ELSE max(roi) + {dbl(0.5)} END AS hi
                                   FROM snet) r2
           GROUP BY 1) c ON c.bin = g.bin""", DEFAULT, extra=_SIM_CTES))
def q_outcome_histogram(spark, sf_dir):
    """44-bin histogram of simulated ROI for the funded set (the distribution chart's table)."""
    from churnlens.operators.simulation import roi_histogram, scenario_outcomes
    dec = B.decision(spark, sf_dir, D.DecisionParams(BUDGET, CAP, STRAT, RATE))
    act = dec.funded.select("customer_id", "churn_probability", "CLV", "retention_cost")
    # n_sims rows, read twice (range and counts): materialise once, lineage cut
    return roi_histogram(scenario_outcomes(act, RATE).checkpoint())


@query("boundary_sample", decision_sql(f"""
SELECT {', '.join(R.BOUNDARY_COLS)} FROM dfinal
WHERE scenario = 'Balanced' AND customer_id IN (SELECT customer_id FROM fl WHERE a + b + c IN (1, 2))
ORDER BY net_retention_value DESC, customer_id LIMIT 10""", _SETS, extra=_FLAGS))
def q_boundary_sample(spark, sf_dir):
    """Top 10 boundary-zone customers by net value (the reviewed sample)."""
    flags, decisions = _sets(spark, sf_dir)
    return R.boundary_zone(flags, decisions["Balanced"].table).limit(10)
