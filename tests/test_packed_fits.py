"""Iterative fits read packed rows, at once; tables that grow are not broadcast."""

import uuid

import pytest
from pyspark.sql import functions as F

from churnlens.operators import model as M
from churnlens.operators import uplift as U
from churnlens.sources.tables import raw_account_view


@pytest.fixture(scope="module")
def spread(spark):
    """90 accounts over 48 partitions; NULL values among them."""
    rows = []
    for i in range(90):
        risk = (i * 37 % 90) / 90
        rows.append((f"P{i:03d}", int(risk + (i % 7) / 10 > 0.7), None if i % 29 == 0 else i * 13 % 61, 18.5 + i * 11 % 83, 40.0 + 9 * (i * 17 % 90),
                     ["Month-to-month", "One year", "Two year"][i % 3], "BUILDING" if i % 2 else None, "ASIA" if i % 5 else "EUROPE",
                     900.0 + 3 * i, 25.0 + i % 9, i // 2 % 2))
    return spark.createDataFrame(rows, "customer_id string, churned int, tenure int, MonthlyCharges double, TotalCharges double, plan string, "
                                       "segment string, region string, CLV double, retention_cost double, treat int").repartition(48, "customer_id")


def tasks_of(spark, action, stage_name):
    """Task counts of the stages of that name that ``action`` ran."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, group)
    try:
        out = action()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    status = sc.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds]
    return out, [s.numTasks for s in stages if s is not None and stage_name in s.name]


def test_packed_keeps_every_row_in_partitions_by_rows(spread, monkeypatch):
    kept = M.packed(spread, "customer_id", "tenure", "tenure")
    assert kept.columns == ["customer_id", "tenure"] and kept.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, spread.select("customer_id", "tenure").collect()), key=str)
    monkeypatch.setattr(M, "ROWS_PER_TASK", 30)
    assert M.packed(spread, "plan").rdd.getNumPartitions() == 3
    assert M.packed(spread.where(F.lit(False)), "plan").count() == 0


def test_models_come_in_the_order_asked(spread):
    rows = M.packed(spread, "churned", *M.NUMERIC, *M.CATEGORICAL)
    one, two = M.fit_all([(M.gbt_pipeline(max_iter=3), rows), (M.gbt_pipeline(max_iter=1), rows)])
    assert [m.stages[-1].getNumTrees for m in (one, two)] == [3, 1] and M.fit_all([]) == []


def test_logistic_fit_runs_one_task_a_job(spark, spread):
    (_, holdout, _), tasks = tasks_of(spark, lambda: M.train_and_evaluate(spread), "RDDLossFunction")
    assert tasks and set(tasks) == {1}
    assert holdout.count() == sum(-(-n // 5) for n in (r["count"] for r in spread.groupBy("churned").count().collect()))


def test_bakeoff_and_search_run_one_task_a_job(spark, spread):
    out, tasks = tasks_of(spark, lambda: M.compare_models(spread, k=2, gbt_iter=2).collect(), "RandomForest")
    assert tasks and set(tasks) == {1} and {r["model"] for r in out} == {"Gradient Boosting", "Logistic Regression"}
    out, tasks = tasks_of(spark, lambda: M.tune_gbm(spread, n_trials=2, k=2, iter_range=(1, 3)).collect(), "RandomForest")
    assert tasks and set(tasks) == {1} and [r["trial"] for r in out] == [0, 1]
    assert [r["best"] for r in out] == [r["cv_auc"] == max(x["cv_auc"] for x in out) for r in out]


def test_uplift_models_run_one_task_a_job(spark, spread):
    frame = spread.withColumn("outcome", F.col("churned"))
    up, tasks = tasks_of(spark, lambda: U.two_model_uplift(frame, M.NUMERIC, M.CATEGORICAL, gbt_iter=2), "RandomForest")
    assert tasks and set(tasks) == {1}
    models = U.outcome_models([*U.arms(frame), frame], M.NUMERIC, M.CATEGORICAL, gbt_iter=2)
    given = U.two_model_uplift(frame, M.NUMERIC, M.CATEGORICAL, models=models[:2])
    assert sorted(r["uplift"] for r in up.collect()) == pytest.approx(sorted(r["uplift"] for r in given.collect()))
    alone = U.response_propensity(frame, M.NUMERIC, M.CATEGORICAL, gbt_iter=2).agg(F.sum("propensity")).first()[0]
    assert U.response_propensity(frame, M.NUMERIC, M.CATEGORICAL, model=models[2]).agg(F.sum("propensity")).first()[0] == pytest.approx(alone)


def test_customers_are_not_broadcast(spark, tmp_path):
    day = "TIMESTAMP_NTZ'1997-0{}-11 00:00:00'"
    tables = {"customer": "SELECT id AS c_custkey, id % 2 AS c_nationkey, 'MACHINERY' AS c_mktsegment FROM range(1, 6)",
              "orders": f"SELECT id % 4 + 1 AS o_custkey, IF(id < 6, {day.format(2)}, {day.format(8)}) AS o_orderdate, 310.5D + id AS o_totalprice FROM range(12)",
              "nation": "SELECT id AS n_nationkey, id AS n_regionkey FROM range(2)",
              "region": "SELECT id AS r_regionkey, concat('R', id) AS r_name FROM range(2)"}
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(str(tmp_path / f"{name}.parquet"))
    view = raw_account_view(spark, str(tmp_path))
    assert "SortMergeJoin [c_custkey" in view._jdf.queryExecution().sparkPlan().toString()
    assert sorted(r["customerID"] for r in view.collect()) == ["C-1", "C-2", "C-3", "C-4"]
