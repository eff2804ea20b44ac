"""Retention scores, strategy weighting, the constrained decision and its
per-row outputs.

``decide`` is a composition of column expressions plus one greedy selection:
the funded set comes back as a predicate, so the ACT / MONITOR / IGNORE label is
a ``when`` over the scored table — no join, no shuffle. Whole-table quantiles for
the rule-based reasons are scalar subqueries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens import config as C
from churnlens.functions.columns import fixed, micro, strategy_weight
from churnlens.functions.quantiles import column_quantiles
from churnlens.operators.packing import PackResult, greedy_pack, greedy_pack_stacked


@dataclass(frozen=True)
class DecisionParams:
    """Parameters of a decision request, with the request contract's range checks."""
    budget: float = C.DEFAULT_BUDGET
    max_customers: int | None = C.DEFAULT_MAX_CUSTOMERS
    strategy: str = C.DEFAULT_STRATEGY
    save_rate: float = C.SAVE_RATE

    def __post_init__(self):
        if not self.budget > 0:
            raise ValueError("budget must be > 0")
        if self.max_customers is not None and not self.max_customers >= 1:
            raise ValueError("max_customers must be >= 1 (or None for no cap)")
        if self.strategy.lower() not in C.STRATEGY_WEIGHTS:
            raise ValueError(f"Unknown strategy: {self.strategy}")
        if not (0 < self.save_rate <= 1):
            raise ValueError("save_rate must be in (0, 1]")


def retention_columns(save_rate: float | Column) -> dict[str, Column]:
    """Expressions over the scored table: revenue_at_risk = p*CLV; net = save_rate*revenue_at_risk - cost;
    priority = max(net, 0)."""
    rar = fixed(F.col("churn_probability") * F.col("CLV"), 4)
    rate = save_rate if isinstance(save_rate, Column) else F.lit(float(save_rate))
    net = fixed(rate * rar - F.col("retention_cost"), 4)
    return {"revenue_at_risk": rar, "net_retention_value": net, "retention_priority_score": F.greatest(net, F.lit(0.0))}


def build_retention_scores(scored: DataFrame, save_rate: float = C.SAVE_RATE) -> DataFrame:
    """The scored table with :func:`retention_columns` (one projection: each DataFrame operation
    costs an analysis pass)."""
    return scored.withColumns(retention_columns(save_rate))


def adjusted_priority(priority: Column, strategy: str) -> Column:
    return fixed(priority * strategy_weight("risk_band", strategy), 6)


def apply_decision_strategy(df: DataFrame, strategy: str) -> DataFrame:
    """Band weight for the strategy (case-insensitive) and ``adjusted_priority``."""
    return df.withColumns({"strategy_weight": strategy_weight("risk_band", strategy),
                           "adjusted_priority": adjusted_priority(F.col("retention_priority_score"), strategy)})


def eligible(df: DataFrame) -> Column:
    return (F.col("retention_cost") > 0) & (F.col("net_retention_value") > 0)


def select_under_budget(df: DataFrame, budget: float, max_customers: int | None,
                        order_col: str | None = None, **kw) -> PackResult:
    """Greedy K1: eligible rows by ``adjusted_priority`` if present else
    ``efficiency``, descending (ties by customer id)."""
    if order_col is None:
        order_col = "adjusted_priority" if "adjusted_priority" in df.columns else "efficiency"
    elig = df.where(eligible(df))
    if order_col == "efficiency" and "efficiency" not in df.columns:
        elig = elig.withColumn("efficiency", efficiency_col())
    res = greedy_pack(elig, [(order_col, True)], budget, max_customers, **kw)
    res.eligible = eligible(df)
    return res


def efficiency_col() -> Column:
    return F.when(F.col("retention_cost") > 0,
                  fixed(F.col("net_retention_value") / F.col("retention_cost"), 6))


class Decision:
    """A decision: the strategy-weighted score table, the funded-set predicate and
    the parameters. The full decision table (segments, efficiency, reasons) is
    built lazily on first use; aggregates over the funded rows can use
    ``funded`` without it."""

    def __init__(self, scores: DataFrame, pack: PackResult, params: DecisionParams,
                 reasons: Callable[[DataFrame], Column] | None = None):
        self.scores, self.pack, self.params, self.reasons = scores, pack, params, reasons
        self._table = None

    @property
    def table(self) -> DataFrame:
        if self._table is None:
            seg = (F.when(self.pack.predicate, "ACT")
                   .when(F.col("net_retention_value") > 0, "MONITOR").otherwise("IGNORE"))
            t = (self.scores.withColumns({"action_segment": seg, "efficiency": efficiency_col()})
                 .drop("strategy_weight", "adjusted_priority"))
            self._table = add_reasons_and_actions(t, self.reasons(self.funded) if self.reasons else None)
        return self._table

    @property
    def act(self) -> DataFrame:
        return self.table.where(F.col("action_segment") == "ACT")

    @property
    def funded(self) -> DataFrame:
        """The ACT rows of the score table (no reason / action columns)."""
        return self.scores.where(self.pack.predicate)

    @property
    def spent(self) -> float:
        return self.pack.spent


def side_by_side(scored: DataFrame, decisions: list[Decision]) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """The scored table with every decision's columns next to each other, and per decision
    (is the row funded, its net value): one aggregate can look at many decisions."""
    df = scored.withColumn("__rar", retention_columns(0.0)["revenue_at_risk"])
    df = df.withColumns({f"__net{k}": fixed(F.lit(float(d.params.save_rate)) * F.col("__rar") - F.col("retention_cost"), 4)
                         for k, d in enumerate(decisions)})
    df = df.withColumns({f"__order{k}": adjusted_priority(F.greatest(F.col(f"__net{k}"), F.lit(0.0)), d.params.strategy)
                         for k, d in enumerate(decisions)})
    df = df.withColumns({f"__in{k}": (F.col("retention_cost") > 0) & (F.col(f"__net{k}") > 0)
                         & d.pack.taken(adjusted_priority=F.col(f"__order{k}")) for k, d in enumerate(decisions)})
    return df, [(F.col(f"__in{k}"), F.col(f"__net{k}")) for k in range(len(decisions))]


def decide(scored: DataFrame, params: DecisionParams = DecisionParams(), pack: PackResult | None = None,
           reasons: Callable[[DataFrame], Column] | None = None) -> Decision:
    """Scores -> strategy -> greedy selection -> segments, efficiency, reasons, actions.

    ``pack`` may carry a selection computed elsewhere (see ``decide_many``). ``reasons`` makes the
    reason of a row from the funded rows (``explain.model_reasons``); without it, rules do."""
    df = build_retention_scores(scored, params.save_rate)
    strat = apply_decision_strategy(df, params.strategy)
    if pack is None:
        pack = select_under_budget(strat, params.budget, params.max_customers)
    return Decision(strat, pack, params, reasons)


def add_reasons_and_actions(table: DataFrame, reason: Column | None = None) -> DataFrame:
    """Reason (given, or rule-based: first 3 of 5 rules) and recommended action, ACT rows only.

    Medians and the CLV upper quartile are over the whole table (exact
    distributed quantiles, read as one scalar subquery).
    """
    q = column_quantiles(table, ["CLV", "retention_cost"], [0.5, 0.75])
    clv_median, clv_q75 = F.element_at(q.getField("CLV"), 1), F.element_at(q.getField("CLV"), 2)
    cost_median = F.element_at(q.getField("retention_cost"), 1)
    band = F.col("risk_band")
    parts = [
        F.when(band == "HIGH", F.lit(C.REASON_HIGH)).when(band == "MEDIUM", F.lit(C.REASON_MEDIUM)),
        F.when(F.col("CLV") >= clv_median, F.lit(C.REASON_VALUE)),
        F.when(F.col("retention_cost") <= cost_median, F.lit(C.REASON_COST)),
        F.when(F.col("plan") == "Month-to-month", F.lit(C.REASON_NO_CONTRACT)),
        F.when(F.col("tenure") <= 6, F.lit(C.REASON_NEW)),
    ]
    # keep the first three present parts (no lambda: the thresholds are scalar
    # subqueries, which Spark does not allow inside higher-order functions)
    kept, seen = [], F.lit(0)
    for p in parts:
        seen = seen + F.when(p.isNotNull(), 1).otherwise(0)
        kept.append(F.when(seen <= 3, p))
    reason = F.concat_ws(" + ", *kept) if reason is None else reason
    action = (F.when((band == "HIGH") & (F.col("CLV") >= clv_q75), F.lit(C.ACTION_PREMIUM))
              .when(band == "HIGH", F.lit(C.ACTION_DISCOUNT))
              .when(band == "MEDIUM", F.lit(C.ACTION_EMAIL))
              .otherwise(F.lit(C.ACTION_STANDARD)))
    is_act = F.col("action_segment") == "ACT"
    return table.withColumns({"decision_reason": F.when(is_act, reason).otherwise(F.lit("")),
                              "recommended_action": F.when(is_act, action).otherwise(F.lit(""))})


def loss_share(scored: DataFrame) -> DataFrame:
    """Share of HIGH-band rows where ignoring costs more than acting (NULL if none)."""
    return (scored.where(F.col("risk_band") == "HIGH")
            .agg(fixed(F.avg(F.when(F.col("loss_if_ignore") > F.col("loss_if_act"), 1.0).otherwise(0.0)), 6)
                 .alias("loss_share")))


def act_totals(decision_table: DataFrame) -> DataFrame:
    """Exact sums over ACT rows: count, cost, net value, revenue at risk (1 row)."""
    return funded_totals(decision_table.where(F.col("action_segment") == "ACT"))


def funded_totals(act: DataFrame) -> DataFrame:
    """Exact sums over funded rows: count, cost, net value, revenue at risk (1 row)."""
    return act.agg(F.count(F.lit(1)).alias("act_count"),
                   (F.coalesce(F.sum(micro("retention_cost")), F.lit(0)) / F.lit(float(C.MICRO))).alias("act_cost"),
                   (F.coalesce(F.sum(micro("net_retention_value")), F.lit(0)) / F.lit(float(C.MICRO))).alias("act_net"),
                   (F.coalesce(F.sum(micro("revenue_at_risk")), F.lit(0)) / F.lit(float(C.MICRO))).alias("act_rar"))


def decision_kpis(decision_table: DataFrame) -> DataFrame:
    """Counts per segment, total net value and cost of ACT, ROI = net / max(cost, 1)."""
    t = decision_table
    seg = F.col("action_segment")
    is_act = seg == "ACT"
    net = F.coalesce(F.sum(F.when(is_act, micro("net_retention_value"))), F.lit(0)) / F.lit(float(C.MICRO))
    cost = F.coalesce(F.sum(F.when(is_act, micro("retention_cost"))), F.lit(0)) / F.lit(float(C.MICRO))
    return (t.agg(F.count(F.when(is_act, 1)).alias("act"),
                  F.count(F.when(seg == "MONITOR", 1)).alias("monitor"),
                  F.count(F.when(seg == "IGNORE", 1)).alias("ignore"),
                  net.alias("total_net_value"), cost.alias("total_cost"))
            .withColumn("roi", fixed(F.col("total_net_value") / F.greatest(F.col("total_cost"), F.lit(1.0)), 6))
            .withColumn("total_net_value", fixed("total_net_value", 4))
            .withColumn("total_cost", fixed("total_cost", 4)))


def decision_response(decision: Decision) -> DataFrame:
    """Decision-request summary (1 row): act_count, budget_used, expected_revenue_saved, roi."""
    spent = decision.spent
    t = act_totals(decision.table)
    return t.select(
        F.col("act_count"),
        fixed(F.lit(spent), 2).alias("budget_used"),
        fixed(F.col("act_net"), 2).alias("expected_revenue_saved"),
        fixed(F.col("act_net") / F.lit(max(spent, 1.0)), 2).alias("roi"))


def act_list(decision: Decision) -> DataFrame:
    """ACT rows, net value descending, with the request's rounding."""
    return (decision.act
            .select("customer_id", "risk_band",
                    fixed("churn_probability", 3).alias("churn_probability"),
                    fixed("CLV", 2).alias("clv"),
                    fixed("retention_cost", 2).alias("retention_cost"),
                    fixed("net_retention_value", 2).alias("net_retention_value"),
                    "recommended_action")
            .orderBy(F.col("net_retention_value").desc(), "customer_id"))


EXPORT_COLUMNS = ["customer_id", "risk_band", "churn_probability", "CLV", "retention_cost", "net_retention_value",
                  "efficiency", "decision_reason", "recommended_action"]


def act_export(decision: Decision) -> DataFrame:
    """The nine columns of the ACT export, unrounded, net value descending."""
    return decision.act.select(*EXPORT_COLUMNS).orderBy(F.col("net_retention_value").desc(), "customer_id")


def decide_many(scored: DataFrame, params_list: list[DecisionParams]) -> list[Decision]:
    """Several decisions at once: one scan gives the eligible rows of every scenario, and the
    walks of all share their jobs."""
    weights = [C.STRATEGY_WEIGHTS[p.strategy.lower()] for p in params_list]
    own = [f"named_struct('lane', {i}, 'rate', CAST({p.save_rate!r} AS DOUBLE), "
           + ", ".join(f"'{band}', CAST({w[band]!r} AS DOUBLE)" for band in w) + ")" for i, (p, w) in enumerate(zip(params_list, weights))]
    each = (scored.where(F.col("retention_cost") > 0)
            .select("customer_id", "retention_cost", "churn_probability", "CLV", "risk_band", F.expr(f"explode(array({', '.join(own)}))").alias("s"))
            .select("*", *[e.alias(n) for n, e in retention_columns(F.col("s.rate")).items()]).where(F.col("net_retention_value") > 0))
    weight = F.coalesce(*[F.when(F.col("risk_band") == band, F.col(f"s.{band}")) for band in weights[0]])
    each = each.select("customer_id", "retention_cost", F.col("s.lane").alias("lane"),
                       fixed(F.col("retention_priority_score") * weight, 6).alias("adjusted_priority"))
    packs = greedy_pack_stacked(each, [("adjusted_priority", True)], [p.budget for p in params_list],
                                [p.max_customers for p in params_list])
    for pack in packs:
        pack.eligible = eligible(scored)
    return [decide(scored, p, pack=pack) for p, pack in zip(params_list, packs)]
