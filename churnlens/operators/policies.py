"""Decision checks: naive-policy baselines, lift, save-rate sensitivity, ROI
sweep, strategy comparison and an optimality bound.

Every check reuses the persisted scored table: all its selections are one call of the
greedy (see :mod:`churnlens.operators.packing`), and one aggregate with a condition per
selection gives the whole result — no customer rows reach the driver.
"""

from __future__ import annotations

import math
from itertools import combinations, product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens import config as C
from churnlens.functions.columns import fixed, hash_u32, micro
from churnlens.operators import decision as D
from churnlens.operators.packing import greedy_pack, greedy_pack_many

NAIVE_POLICIES = ["Random", "Target highest churn", "Target highest CLV"]
ENGINE_POLICY = "Decision engine"
DUAL_GAP = 1e-9


def _money(col, when=None):
    value = micro(col) if when is None else F.when(when, micro(col))
    return F.coalesce(F.sum(value), F.lit(0)) / F.lit(float(C.MICRO))


def _per_selection(df: DataFrame, selections: list[dict]) -> DataFrame:
    """One row per selection: its aggregates (name -> expression), all from one pass."""
    return df.agg(F.array(*[F.struct(*[e.alias(n) for n, e in s.items()]) for s in selections]).alias("s")).select(F.inline("s"))


def compare_policies(scored: DataFrame, budget: float, max_customers: int | None,
                     save_rate: float = C.SAVE_RATE, seed: int = C.SEED) -> DataFrame:
    """Fill the same budget in four orders: random (md5 of seed and id), highest
    churn, highest CLV, and the engine (net value > 0, net value descending)."""
    df = (D.build_retention_scores(scored, save_rate).where(F.col("retention_cost") > 0)
          .withColumn("random_key", hash_u32(F.lit(str(seed)), F.col("customer_id"))))
    engine = F.col("net_retention_value") > 0
    orders = {"Random": [("random_key", False)], "Target highest churn": [("churn_probability", True)],
              "Target highest CLV": [("CLV", True)], ENGINE_POLICY: [("net_retention_value", True)]}
    tables = {name: df.where(engine) if name == ENGINE_POLICY else df for name in orders}
    packs = greedy_pack_many(tables, orders, dict.fromkeys(orders, budget), dict.fromkeys(orders, max_customers))
    taken = {name: pack.predicate & engine if name == ENGINE_POLICY else pack.predicate for name, pack in packs.items()}
    out = _per_selection(df, [
        {"policy": F.lit(name), "customers": F.count(F.when(t, 1)), "cost": _money("retention_cost", t),
         "value": _money("net_retention_value", t)} for name, t in taken.items()])
    return out.select("policy", "customers", fixed("cost", 2).alias("budget_used"),
                      fixed("value", 2).alias("expected_value"),
                      F.when(F.col("cost") > 0, fixed(F.col("value") / F.col("cost"), 4))
                      .otherwise(F.lit(0.0)).alias("roi"))


def policy_lift(policies: DataFrame) -> DataFrame:
    """Engine value vs the best naive policy: ``(engine - best) / max(best, 1) * 100``."""
    naive = policies.where(F.col("policy") != ENGINE_POLICY)
    engine_value = (policies.where(F.col("policy") == ENGINE_POLICY)
                    .select(F.max("expected_value")).scalar())
    return naive.agg(F.max_by("policy", F.struct("expected_value", F.col("policy"))).alias("best_naive_policy"),
                     F.max("expected_value").alias("best_naive_value")).select(
        "best_naive_policy", "best_naive_value", engine_value.alias("engine_value"),
        fixed((engine_value - F.col("best_naive_value"))
              / F.greatest(F.col("best_naive_value"), F.lit(1.0)) * F.lit(100.0), 4).alias("lift_pct"))


def save_rate_sensitivity(funded: DataFrame, assumed: float = C.SAVE_RATE,
                          steps: int = 20) -> DataFrame:
    """Net value of the funded set at true save rates 0, 0.05, ..., 1 and the
    break-even rate ``cost / sum(p*CLV)`` (NULL when nothing is at risk).
    Accepts the funded rows or a full decision table (ACT rows are used)."""
    t = (D.act_totals(funded) if "action_segment" in funded.columns else D.funded_totals(funded))
    rates = F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k")
    be = F.when(F.col("act_rar") != 0, F.col("act_cost") / F.col("act_rar"))
    return (t.select("act_cost", "act_rar", rates)
            .withColumn("rate", fixed(F.col("k") * F.lit(1.0 / steps), 2))
            .select("rate",
                    fixed(F.col("rate") * F.col("act_rar") - F.col("act_cost"), 2).alias("net_value"),
                    fixed(be, 6).alias("break_even"),
                    F.lit(float(assumed)).alias("assumed"),
                    fixed(F.lit(float(assumed)) - be, 6).alias("margin_of_safety"),
                    fixed("act_rar", 4).alias("revenue_at_risk"), fixed("act_cost", 4).alias("cost")))


def roi_sweep(scored: DataFrame, budget: float, max_customers: int | None, strategy: str,
              rates=tuple(round(0.1 * i, 2) for i in range(1, 11)), decide_many=D.decide_many) -> DataFrame:
    """Re-decide at each save rate; ROI = net / max(cost, 1) of the ACT set."""
    decs = decide_many(scored, [D.DecisionParams(budget, max_customers, strategy, r) for r in rates])
    df, columns = D.side_by_side(scored, decs)
    selections = []
    for r, (funded, net) in zip(rates, columns):
        selections.append({"save_rate": F.lit(float(r)), "act_count": F.count(F.when(funded, 1)), "roi": fixed(
            _money(net, funded) / F.greatest(_money("retention_cost", funded), F.lit(1.0)), 6)})
    return _per_selection(df, selections)


def strategy_comparison(scored: DataFrame, budget: float, max_customers: int | None,
                        save_rate: float = C.SAVE_RATE, decide_many=D.decide_many) -> DataFrame:
    """Per strategy: ACT count, % HIGH, % MEDIUM, revenue saved, budget used, ROI."""
    decs = decide_many(scored, [D.DecisionParams(budget, max_customers, s, save_rate) for s in C.STRATEGIES])
    df, columns = D.side_by_side(scored, decs)
    selections = []
    for s, (funded, net) in zip(C.STRATEGIES, columns):
        share = lambda band: fixed(F.avg(F.when(funded, F.when(F.col("risk_band") == band, 1.0).otherwise(0.0))) * 100, 4)  # noqa: E731, B023
        saved, cost = _money(net, funded), _money("retention_cost", funded)
        selections.append({
            "strategy": F.lit(s), "act_customers": F.count(F.when(funded, 1)), "pct_high": share("HIGH"), "pct_medium": share("MEDIUM"),
            "revenue_saved": fixed(saved, 2), "budget_used": fixed(cost, 2), "roi": fixed(saved / F.greatest(cost, F.lit(1.0)), 6)})
    return _per_selection(df, selections)


def optimality_bound(scored: DataFrame, budget: float, max_customers: int | None,
                     save_rate: float = C.SAVE_RATE) -> DataFrame:
    """Greedy-by-efficiency value against an upper bound on the exact 0/1 knapsack
    optimum (budget B and cap K), the dual

        OPT <= min over l, m >= 0 of  l * B + m * K + sum of the positive (v_i - l * c_i - m)

    (without a cap, m = 0). Every (l, m) gives a bound, and sum and slopes there are one
    aggregate; the minimum is sought with cutting planes, a few points a pass, until the
    planes leave no more than ``DUAL_GAP`` of the bound. The bound is rounded up to cents, so
    ``capture_pct_lower_bound`` = greedy / bound * 100 is a certified lower bound on the
    share of the optimum that the greedy captures (100 when the bound is 0)."""
    df = D.build_retention_scores(scored, save_rate)
    elig = df.where(D.eligible(df)).withColumn("efficiency", D.efficiency_col())
    pack = greedy_pack(elig, [("efficiency", True)], budget, max_customers)
    greedy = elig.where(pack.predicate).agg(F.count(F.lit(1)).alias("greedy_customers"),
                                            _money("net_retention_value").alias("greedy_value"))
    bound = F.lit(math.ceil(round(dual_bound(elig, budget, max_customers) * 100, 6)) / 100)
    return greedy.select(
        fixed("greedy_value", 4).alias("greedy_value"), "greedy_customers", bound.alias("upper_bound"),
        F.when(bound > 0, fixed(F.col("greedy_value") / bound * F.lit(100.0), 4))
        .otherwise(F.lit(100.0)).alias("capture_pct_lower_bound"))


def dual_bound(elig: DataFrame, budget: float, max_customers: int | None, passes: int = 40) -> float:
    """The smallest dual bound found for rows (net_retention_value, retention_cost), both positive."""
    limits = [float(budget)] + ([float(max_customers)] if max_customers else [])
    v, c = F.col("net_retention_value"), F.col("retention_cost")
    top = elig.agg(F.max(v / c).alias("l"), F.max(v).alias("m")).first()
    if top["l"] is None:
        return 0.0
    box = np.array([top["l"], top["m"]][:len(limits)])
    points = [box * np.array(at) for at in product((0.0, 0.05, 0.2, 0.5), repeat=len(box))]
    planes, best, best_at = [], math.inf, box
    for _ in range(passes):
        sums = []
        for k, p in enumerate(points):
            gain = v - F.lit(float(p[0])) * c - F.lit(float(p[1]) if len(p) > 1 else 0.0)
            sums += [F.sum(F.when(gain > 0, gain)).alias(f"s{k}"), F.sum(F.when(gain > 0, c)).alias(f"c{k}"),
                     F.count(F.when(gain > 0, 1)).alias(f"n{k}")]
        found = elig.agg(*sums).first()
        for k, p in enumerate(points):
            value = float(np.dot(p, limits)) + (found[f"s{k}"] or 0.0)
            slope = np.array([limits[0] - (found[f"c{k}"] or 0.0)] + [n - found[f"n{k}"] for n in limits[1:]])
            planes.append(np.array([*slope, value - slope @ p]))     # value >= slope . x + rest
            if value < best:
                best, best_at = value, p
        low, at = _lowest(np.array(planes), box, best_at)
        if best - low <= DUAL_GAP * max(best, 1.0):
            break
        points = [at, (at + best_at) / 2, at + (at - best_at) / 4]
        points = [np.clip(p, 0, box) for p in points]
    return best


def _lowest(planes: np.ndarray, box: np.ndarray, near: np.ndarray, kept: int = 48) -> tuple[float, np.ndarray]:
    """The lowest point of the upper hull of planes (slopes..., rest) within the box, over its
    corners: all meetings of as many planes and sides as there are unknowns."""
    d = len(box)
    hull = planes[np.argsort(-(planes[:, :d] @ near + planes[:, d]))[:kept]]
    # unknowns (x, t): slope . x - t = -rest, x_k = 0, x_k = box_k
    rows = [np.append(p[:d], -1.0) for p in hull] + [np.eye(d + 1)[k] for k in range(d) for _ in (0, 1)]
    right = [-p[d] for p in hull] + [side for k in range(d) for side in (0.0, box[k])]
    some = np.array(list(combinations(range(len(rows)), d + 1)))
    left, right = np.array(rows)[some], np.array(right)[some]
    fit = np.abs(np.linalg.det(left)) > 1e-9
    corners = np.linalg.solve(left[fit], right[fit][..., None])[..., 0]
    inside = ((corners[:, :d] >= -1e-9 * box) & (corners[:, :d] <= box * (1 + 1e-9))).all(1)
    corners = corners[inside]
    height = (corners[:, :d] @ hull[:, :d].T + hull[:, d]).max(1)
    lowest = int(np.argmin(height))
    return float(height[lowest]), np.clip(corners[lowest, :d], 0, box)
