"""Registered queries: retention scores, strategy, constrained decision outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens import config as C
from churnlens.functions.columns import fixed, strategy_weight
from churnlens.operators import decision as D
from churnlens.operators.explain import Term, level_phrase, phrases, probability
from churnlens.plans import base as B
from churnlens.plans import oracle as O
from churnlens.plans.oracle_decision import DEFAULT, Scenario, decision_sql
from churnlens.plans.registry import query

DEFAULT_PARAMS = D.DecisionParams()
UNCAPPED_BUDGET, LARGE_CAP = 60_000.0, 100_000

_SCORE_COLS = ["customer_id", "churn_probability", "CLV", "retention_cost", "revenue_at_risk",
               "net_retention_value", "retention_priority_score"]


@query("retention_scores", decision_sql(f"SELECT {', '.join(_SCORE_COLS)} FROM ds", DEFAULT))
def q_retention_scores(spark, sf_dir):
    """Revenue at risk, net retention value and priority (save rate 0.30)."""
    return D.build_retention_scores(B.scored(spark, sf_dir), C.SAVE_RATE).select(*_SCORE_COLS)


_STRAT_SQL = " UNION ALL ".join(
    f"SELECT '{s}' AS strategy, customer_id, strategy_weight, adjusted_priority FROM ds WHERE scenario = '{s}'"
    for s in C.STRATEGIES)


@query("strategy_priority", decision_sql(_STRAT_SQL, [
    Scenario(s, strategy=s)
    for s in C.STRATEGIES]))
def q_strategy_priority(spark, sf_dir):
    """Band weight and adjusted priority for all three strategies in one pass."""
    scores = D.build_retention_scores(B.scored(spark, sf_dir), C.SAVE_RATE)
    long = scores.select("customer_id", "risk_band", "retention_priority_score",
                         F.explode(F.array(*[F.lit(s) for s in C.STRATEGIES])).alias("strategy"))
    weight = None
    for s in C.STRATEGIES:
        w = strategy_weight("risk_band", s)
        weight = F.when(F.col("strategy") == s, w) if weight is None else weight.when(F.col("strategy") == s, w)
    return (long.withColumn("strategy_weight", weight)
            .select("strategy", "customer_id", "strategy_weight",
                    fixed(F.col("retention_priority_score") * F.col("strategy_weight"), 6).alias("adjusted_priority")))


def default_decision(spark, sf_dir, params: D.DecisionParams = DEFAULT_PARAMS) -> D.Decision:
    return B.decision(spark, sf_dir, params)


@query("select_under_budget", decision_sql("""
SELECT d.customer_id, d.retention_cost, d.net_retention_value, d.adjusted_priority
FROM ds d JOIN dsel s ON s.scenario = d.scenario AND s.customer_id = d.customer_id""", DEFAULT))
def q_select_under_budget(spark, sf_dir):
    """Greedy budget + capacity selection (budget 25k, cap 300, Balanced)."""
    return _selection(spark, sf_dir, C.DEFAULT_BUDGET, C.DEFAULT_MAX_CUSTOMERS)


_SELECTED = """
SELECT d.customer_id, d.retention_cost, d.net_retention_value, d.adjusted_priority
FROM ds d JOIN dsel s ON s.scenario = d.scenario AND s.customer_id = d.customer_id"""


def _selection(spark, sf_dir, budget, max_customers):
    scores = D.apply_decision_strategy(
        D.build_retention_scores(B.scored(spark, sf_dir), C.SAVE_RATE), C.DEFAULT_STRATEGY)
    pack = D.select_under_budget(scores, budget, max_customers)
    return scores.where(pack.predicate).select("customer_id", "retention_cost", "net_retention_value",
                                              "adjusted_priority")


@query("select_uncapped", decision_sql(_SELECTED, [Scenario("uncapped", budget=UNCAPPED_BUDGET, max_customers=None)]))
def q_select_uncapped(spark, sf_dir):
    """Greedy selection by the budget alone (no capacity limit)."""
    return _selection(spark, sf_dir, UNCAPPED_BUDGET, None)


@query("select_large_cap", decision_sql(_SELECTED, [Scenario("large", budget=UNCAPPED_BUDGET, max_customers=LARGE_CAP)]))
def q_select_large_cap(spark, sf_dir):
    """Greedy selection with a capacity of 100,000 accounts."""
    return _selection(spark, sf_dir, UNCAPPED_BUDGET, LARGE_CAP)


_SEG_COLS = ["customer_id", "risk_band", "churn_probability", "CLV", "retention_cost", "revenue_at_risk",
             "net_retention_value", "retention_priority_score", "action_segment", "efficiency"]


@query("action_segments", decision_sql(f"SELECT {', '.join(_SEG_COLS)} FROM dfinal", DEFAULT))
def q_action_segments(spark, sf_dir):
    """ACT / MONITOR / IGNORE for every account with efficiency."""
    return default_decision(spark, sf_dir).table.select(*_SEG_COLS)


@query("decision_kpis", decision_sql(f"""
SELECT count(*) FILTER (WHERE action_segment = 'ACT') AS act,
       count(*) FILTER (WHERE action_segment = 'MONITOR') AS monitor,
       count(*) FILTER (WHERE action_segment = 'IGNORE') AS ignore,
       {O.fx(f"coalesce(sum(CASE WHEN action_segment = 'ACT' THEN CAST(floor(net_retention_value * {O.dbl(1e4)} + {O.dbl(0.5)}) AS BIGINT) END), 0) / {O.dbl(1e4)}", 4)} AS total_net_value,
       {O.fx(f"coalesce(sum(CASE WHEN action_segment = 'ACT' THEN cost_micro END), 0) / {O.dbl(1e4)}", 4)} AS total_cost,
       {O.fx(f"(coalesce(sum(CASE WHEN action_segment = 'ACT' THEN CAST(floor(net_retention_value * {O.dbl(1e4)} + {O.dbl(0.5)}) AS BIGINT) END), 0) / {O.dbl(1e4)}) / greatest(coalesce(sum(CASE WHEN action_segment = 'ACT' THEN cost_micro END), 0) / {O.dbl(1e4)}, {O.dbl(1.0)})", 6)} AS roi
FROM dfinal""", DEFAULT))
def q_decision_kpis(spark, sf_dir):
    """Segment counts, ACT net value and cost, ROI."""
    return D.decision_kpis(default_decision(spark, sf_dir).table)


@query("decision_response", decision_sql(f"""
SELECT count(*) AS act_count, {O.fx('max(sp.spent)', 2)} AS budget_used,
       {O.fx(f"coalesce(sum(CAST(floor(d.net_retention_value * {O.dbl(1e4)} + {O.dbl(0.5)}) AS BIGINT)), 0) / {O.dbl(1e4)}", 2)} AS expected_revenue_saved,
       {O.fx(f"(coalesce(sum(CAST(floor(d.net_retention_value * {O.dbl(1e4)} + {O.dbl(0.5)}) AS BIGINT)), 0) / {O.dbl(1e4)}) / greatest(max(sp.spent), {O.dbl(1.0)})", 2)} AS roi
FROM dspent sp LEFT JOIN dfinal d ON d.scenario = sp.scenario AND d.action_segment = 'ACT'""", DEFAULT))
def q_decision_response(spark, sf_dir):
    """Decision request (budget 25k, cap 300, Balanced, save rate 0.30): summary row."""
    return D.decision_response(default_decision(spark, sf_dir))


@query("act_list", decision_sql(f"""
SELECT customer_id, risk_band, {O.fx('churn_probability', 3)} AS churn_probability, {O.fx('CLV', 2)} AS clv,
       {O.fx('retention_cost', 2)} AS retention_cost, {O.fx('net_retention_value', 2)} AS net_retention_value,
       recommended_action
FROM dfinal WHERE action_segment = 'ACT' ORDER BY net_retention_value DESC, customer_id""", DEFAULT))
def q_act_list(spark, sf_dir):
    """ACT list export (request rounding), net value descending."""
    return D.act_list(default_decision(spark, sf_dir))


@query("act_export", decision_sql(f"""
SELECT {', '.join(D.EXPORT_COLUMNS)} FROM dfinal WHERE action_segment = 'ACT' ORDER BY net_retention_value DESC, customer_id""", DEFAULT))
def q_act_export(spark, sf_dir):
    """The ACT export: nine columns with efficiency, reason and action."""
    return D.act_export(default_decision(spark, sf_dir))


# a literal model: column, level, weight, mean, median
_TERMS = [Term("tenure", None, -0.03, 20.0, 12.0), Term("MonthlyCharges", None, 0.0001, 9000.0, 8000.0),
          Term("TotalCharges", None, 0.000002, 150000.0, 120000.0)] + [
    Term("plan", lv, w, m) for lv, w, m in (("Month-to-month", 0.5, 0.5), ("One year", 0.1, 0.25), ("Two year", -0.6, 0.25))] + [
    Term("region", lv, w, 0.2) for lv, w in (("AFRICA", 0.05), ("ASIA", 0.3), ("EUROPE", -0.2))]
_INTERCEPT = -1.0


def _terms_sql() -> str:
    parts = []
    for j, t in enumerate(_TERMS):
        x = t.column if t.level is None else f"CASE WHEN {t.column} = '{t.level}' THEN {O.dbl(1.0)} ELSE {O.dbl(0.0)} END"
        token = (f"CASE WHEN {t.column} >= {O.dbl(t.median)} THEN 'high ' ELSE 'low ' END || '{C.NUMERIC_LABEL[t.column]}'"
                 if t.level is None else f"'{level_phrase(t.column, t.level)}'")
        parts.append(f"{{'less': {O.dbl(-t.weight)} * (CAST({x} AS DOUBLE) - {O.dbl(t.mean)}), 'j': {j}, 'token': {token}}}")
    return "[" + ", ".join(parts) + "]"


@query("phrase_reasons", O.base(f"""
SELECT customer_id, CASE WHEN len(told) = 0 THEN '{C.NO_REASON}' ELSE array_to_string(told, ', ') END AS decision_reason FROM (
  SELECT customer_id, list_transform(list_slice(list_sort(list_filter({_terms_sql()}, lambda t: t.less < 0)), 1, 3), lambda t: t.token) AS told
  FROM scored)"""))
def q_phrase_reasons(spark, sf_dir):
    """Reason phrases of all accounts under a linear model given as literals."""
    return B.scored(spark, sf_dir).select("customer_id", phrases(_TERMS).alias("decision_reason"))


def _margin_sql() -> str:
    parts = [O.dbl(_INTERCEPT)]
    for t in _TERMS:
        x = t.column if t.level is None else f"CASE WHEN {t.column} = '{t.level}' THEN {O.dbl(1.0)} ELSE {O.dbl(0.0)} END"
        parts.append(f"{O.dbl(t.weight)} * CAST({x} AS DOUBLE)")
    return " + ".join(parts)


@query("lr_scores_literal", O.base(f"""
SELECT customer_id, churned, {O.fx(f"1 / (1 + exp(-({_margin_sql()})))", 6)} AS churn_probability FROM scored"""))
def q_lr_scores_literal(spark, sf_dir):
    """Probabilities of all accounts under a logistic model given as literals."""
    return B.scored(spark, sf_dir).select("customer_id", "churned", fixed(probability(_TERMS, _INTERCEPT), 6).alias("churn_probability"))


@query("rule_reasons", decision_sql("""
SELECT customer_id, decision_reason, recommended_action FROM dfinal WHERE action_segment = 'ACT'""", DEFAULT))
def q_rule_reasons(spark, sf_dir):
    """Rule-based decision reason and recommended action for ACT rows."""
    return default_decision(spark, sf_dir).act.select("customer_id", "decision_reason", "recommended_action")


@query("loss_share", O.base(f"""
SELECT {O.fx(f"avg(CASE WHEN loss_if_ignore > loss_if_act THEN {O.dbl(1.0)} ELSE {O.dbl(0.0)} END)", 6)} AS loss_share
FROM scored WHERE risk_band = 'HIGH'"""))
def q_loss_share(spark, sf_dir):
    """Share of HIGH-risk rows where ignoring costs more than acting."""
    return D.loss_share(B.scored(spark, sf_dir))
