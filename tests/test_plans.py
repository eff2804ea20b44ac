"""Plan-shape regressions for the scale properties the README claims."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from churnlens.operators import decision as D
from churnlens.plans import base as B
from churnlens.sources.tables import account_view

from paths import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_account_view_scans_are_pruned(spark):
    plan = _plan(account_view(spark, SF_SMALL).select("customer_id", "tenure", "churned"))
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in plan \
        or "struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in plan
    assert "o_orderpriority" not in plan and "c_acctbal" not in plan


def test_partial_aggregation_before_order_shuffle(spark):
    plan = _plan(account_view(spark, SF_SMALL))
    assert "partial_min(o_orderdate" in plan and "partial_count(1)" in plan


def test_km_lookup_is_broadcast(spark):
    from churnlens.operators.economics import add_economic_fields
    plan = _plan(add_economic_fields(account_view(spark, SF_SMALL)))
    assert "BroadcastHashJoin" in plan


def test_capped_bound_uses_window_group_limit(spark):
    s = B.scored(spark, SF_SMALL)
    df = D.build_retention_scores(s, 0.3)
    x = df.where(D.eligible(df)).select("net_retention_value", "retention_cost",
                                        F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k"))
    top = (x.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.col("net_retention_value").desc())))
           .where("r <= 5"))
    plan = top._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # partial (before the shuffle) and final
