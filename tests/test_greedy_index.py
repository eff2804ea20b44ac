"""The block-summary index of the greedy selection, and the dual bound."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.operators import packing, policies
from churnlens.operators.packing import greedy_pack_many
from test_packing_decision import sequential_walk


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 7)


def _rows(rng, n):
    return [(f"C-{i:04d}", float(rng.integers(0, 30)), int(rng.integers(0, 50)), round(float(rng.uniform(5, 150)), 2)) for i in range(n)]


def test_walks_over_many_blocks_orders_and_caps_in_one_call(spark, small_blocks):
    rng = np.random.default_rng(11)
    rows = _rows(rng, 400)
    df = spark.createDataFrame(rows, "customer_id string, prio double, draw int, retention_cost double").repartition(5)
    dear = df.where("retention_cost > 60")
    by_prio, by_draw = [("prio", True)], [("draw", False)]
    cases = {"all": (df, by_prio, 1e6, None), "none": (df, by_prio, 1.0, None), "tight": (df, by_prio, 777.77, None),
             "cap": (df, by_prio, 9000.0, 61), "exact cap": (df, by_draw, 1e6, 70), "draw": (df, by_draw, 3210.5, None),
             "two keys": (df, [("draw", False), ("prio", True)], 2000.0, 25), "dear": (dear, by_prio, 1500.0, None)}
    packs = greedy_pack_many({k: c[0] for k, c in cases.items()}, {k: c[1] for k, c in cases.items()},
                             {k: c[2] for k, c in cases.items()}, {k: c[3] for k, c in cases.items()})
    place = {"prio": 1, "draw": 2}
    for name, (table, order, budget, cap) in cases.items():
        keyed = sorted((r for r in rows if table is df or r[3] > 60),
                       key=lambda r: tuple((-r[place[c]] if d else r[place[c]]) for c, d in order) + (r[0],))
        want, spent = sequential_walk([(r[0], None, int(round(r[3] * 10_000))) for r in keyed], int(round(budget * 10_000)), cap)
        got = {r["customer_id"] for r in table.where(packs[name].predicate).collect()}
        assert (got, packs[name].count, packs[name].spent) == (want, len(want), spent / 10_000), name


def test_null_and_negative_costs_null_keys_and_empty_tables(spark, small_blocks):
    df = spark.createDataFrame([("a", 3.0, 5.0), ("b", None, 1.0), ("c", 2.0, None), ("d", 1.0, -4.0), ("e", 0.5, 0.0), (None, 9.0, 1.0)],
                               "customer_id string, prio double, retention_cost double")
    pack = packing.greedy_pack(df, [("prio", True)], 5.0)
    assert {r["customer_id"] for r in pack.selected.collect()} == {"a", "e"} and pack.count == 2
    none = packing.greedy_pack(df.where("prio > 100"), [("prio", True)], 5.0, 3)
    assert none.count == 0 and none.spent == 0 and none.selected.collect() == []


def test_rounds_read_folders_and_blocks_not_the_table(spark, small_blocks, monkeypatch):
    """Block summaries scan the wanted partition's folder, walks filter on block too; taken or passed units are not read."""
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(_rows(rng, 600), "customer_id string, prio double, draw int, retention_cost double").repartition(4)
    plans, reads = [], {"blocks": 0, "walk": 0}
    summary, walk = packing._Index._summary, packing._Index.walk

    def watched(self, *by, where=None):
        out = summary(self, *by, where=where)
        if where is not None:
            reads["blocks"] += 1
            plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    def counted(self, steps):
        reads["walk"] += len({(w.lane, u.part, u.block) for w, u in steps})
        return walk(self, steps)

    monkeypatch.setattr(packing._Index, "_summary", watched)
    monkeypatch.setattr(packing._Index, "walk", counted)
    pack = packing.greedy_pack(df, [("prio", True)], 20_000.0)
    assert pack.count > 200
    assert reads["walk"] <= 1 + 150 / 5 and reads["walk"] < 600 / 7 / 2
    for plan in plans:
        assert "PartitionFilters: [isnotnull(part" in plan or "PartitionFilters: [part#" in plan, plan


@pytest.mark.parametrize("seed", range(4))
def test_dual_bound_is_above_every_choice_and_close_to_the_relaxation(spark, seed):
    rng = np.random.default_rng(seed)
    v, c = rng.uniform(5, 100, 12).round(2), rng.uniform(5, 60, 12).round(2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(v, c)], "net_retention_value double, retention_cost double")
    budget, cap = float(c.sum() * 0.4), int(rng.integers(2, 8))
    for k in (cap, None):
        best = max(sum(v[list(s)]) for n in range((k or 12) + 1) for s in itertools.combinations(range(12), n) if c[list(s)].sum() <= budget)
        bound = policies.dual_bound(df, budget, k)
        grid = [p * budget + sum(sorted(np.maximum(v - p * c, 0), reverse=True)[:k or 12]) for p in np.linspace(0, (v / c).max(), 20001)]
        assert best - 1e-6 <= bound <= min(grid) + 1e-4
    assert policies.dual_bound(df.where(F.lit(False)), budget, cap) == 0.0
