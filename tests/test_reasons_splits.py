"""Reason phrases, split predicates and the imputer stage."""

import math
import os
import tempfile
from hashlib import md5

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from churnlens import config as C
from churnlens.operators import decision as D
from churnlens.operators import explain as X
from churnlens.operators import model as M
from churnlens.operators.imputer import MedianImputer
from churnlens.plans import base as B
from paths import SF_SMALL


def test_phrases_follow_the_rules(spark):
    df = spark.createDataFrame(
        [("a", 70.0, "Male", "No", "Yes", "1", "Mailed check", "No", "x"), ("b", 10.0, "Female", "Fiber optic", "No", "0", None, "No", "y"),
         ("c", None, None, None, None, None, None, None, None)],
        "customer_id string, tenure double, gender string, InternetService string, TechSupport string, SeniorCitizen string, "
        "PaymentMethod string, OnlineBackup string, region string")
    T = X.Term
    terms = [T("tenure", None, 0.1, 20.0, 30.0, 25.0), T("gender", "Male", 9.0), T("InternetService", "No", 2.0), T("InternetService", "Fiber optic", 2.5),
             T("TechSupport", "No", 1.0), T("TechSupport", "Yes", -1.0, 0.5), T("SeniorCitizen", "1", 0.5), T("PaymentMethod", "Mailed check", 0.25),
             T("OnlineBackup", "No", 0.7), T("region", "x", 2.0), T("region", "y", 2.0)]
    got = dict(df.select("customer_id", X.phrases(terms, 3).alias("r")).collect())
    assert got["a"] == "high tenure, no internet, x"               # gender is skipped, ties in the order of the terms
    assert got["b"] == "fiber optic internet, y, no tech support"
    assert got["c"] == "low tenure, tech support"                  # a missing number counts as its fill, a missing level as none
    assert df.select(X.phrases([T("gender", "Male", 9.0)])).first()[0] == C.NO_REASON
    same = [T("region", "x", 3.0), T("PaymentMethod", "X", 2.0), T("tenure", None, 0.01, 0.0, 1.0)]
    one = spark.createDataFrame([("x", "X", 5.0)], "region string, PaymentMethod string, tenure double")
    assert one.select(X.phrases(same, 3)).first()[0] == "x, high tenure"   # equal phrases once


def test_model_reasons_equal_vector_attributions_and_add_no_exchange(spark):
    accounts = B.scored(spark, SF_SMALL)
    model, _, _ = M.train_and_evaluate(accounts)
    terms = X.model_terms(model, accounts)
    from pyspark.ml.functions import vector_to_array
    rows = model.transform(accounts).select("customer_id", vector_to_array("features").alias("f")).collect()
    coefs = model.stages[-1].coefficients.toArray()
    means = [sum(r["f"][j] for r in rows) / len(rows) for j in range(len(coefs))]
    mine = accounts.select("customer_id", *[(F.lit(t.weight) * (t.value() - t.mean)).alias(f"c{j}") for j, t in enumerate(terms)])
    by_id = {r["customer_id"]: r for r in mine.collect()}
    for r in rows:
        for j, w in enumerate(coefs):
            assert abs(by_id[r["customer_id"]][f"c{j}"] - w * (r["f"][j] - means[j])) < 1e-9
    told = accounts.select("customer_id", X.phrases(terms).alias("r"))
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(told) == exchanges(accounts.select("customer_id", "tenure"))
    dec = D.decide(accounts, D.DecisionParams(5000.0, 30), reasons=X.model_reasons(model))
    reasons = {r["customer_id"]: r["decision_reason"] for r in dec.act.collect()}
    funded = {r["customer_id"]: r["decision_reason"] for r in X.linear_reasons(model, dec.funded).collect()}
    assert reasons == funded and len(reasons) > 0
    assert dec.table.where("action_segment != 'ACT' AND decision_reason != ''").count() == 0


def test_splits_are_exact_and_equal_a_full_ranking(spark):
    rows = [(f"c{i}", int(i % 5 == 0)) for i in range(733)]
    df = spark.createDataFrame(rows, "customer_id string, churned int").repartition(4)
    ranked = {lab: sorted((int(md5(f"42|{i}".encode()).hexdigest()[:8], 16), i) for i, c in rows if c == lab) for lab in (0, 1)}
    train, test = M.stratified_split(df, 0.3)
    for lab, order in ranked.items():
        want = {i for _, i in order[:math.ceil(0.3 * len(order))]}
        assert {r["customer_id"] for r in test.where(F.col("churned") == lab).collect()} == want
        for fold, k in ((f, 4) for f in range(4)):
            cut = [-(-len(order) * f // k) for f in range(k + 1)]
            got = {r["customer_id"] for r in M.with_folds(df, k).where((F.col("fold") == fold) & (F.col("churned") == lab)).collect()}
            assert got == {i for _, i in order[cut[fold]:cut[fold + 1]]}
    assert train.count() + test.count() == len(rows)
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Window" not in plan
    odd = df.unionByName(spark.createDataFrame([(None, 1), ("z", None)], df.schema))
    parts = M.stratified_split(odd, 0.3)
    assert sum(p.count() for p in parts) == len(rows) + 2
    none = M.stratified_split(df.where(F.lit(False)))
    assert [p.count() for p in none] == [0, 0]


def test_imputer_round_trip(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, float("nan")), (10.0, None)], "a double, b double")
    model = Pipeline(stages=[MedianImputer(["a", "b"], ["ai", "bi"])]).fit(df)
    path = os.path.join(tempfile.mkdtemp(prefix="imputer-"), "m")
    model.write().overwrite().save(path)
    back = PipelineModel.load(path)
    for m in (model, back):
        assert [tuple(r) for r in m.transform(df).select("ai", "bi").collect()] == [(1.0, 0.0), (2.0, 0.0), (2.0, 0.0), (10.0, 0.0)]


def test_feature_table_names_what_is_missing(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 2.0, 3.0, 0, 5)], "customer_id string, plan string, MRR double, CLV double, retention_cost double, churned int, tenure int")
    assert M.feature_table(df, ["tenure"], ["plan"]).columns == [*C.CONTRACT_COLUMNS, "tenure"]
    with pytest.raises(ValueError, match="gender"):
        M.feature_table(df)


def test_logistic_fit_ends_where_the_penalised_gradient_is_zero(spark):
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    accounts = B.scored(spark, SF_SMALL)
    n = accounts.count()
    for c in (1.0, 0.05):
        model = M.lr_pipeline(n, c).fit(accounts)
        rows = model.transform(accounts).select(vector_to_array("features").alias("f"), F.col(M.TARGET).cast("double").alias("y")).collect()
        x, y, w = np.array([r["f"] for r in rows]), np.array([r["y"] for r in rows]), model.stages[-1].coefficients.toArray()
        off = 1 / (1 + np.exp(-(x @ w + model.stages[-1].intercept))) - y
        assert 0 < y.sum() < n and np.abs(w).max() > 0.01
        assert abs(off.mean()) < 1e-5                              # the intercept bears no penalty
        assert np.abs(x.T @ off / n + w / (c * n)).max() < 1e-5    # L2 with C on the summed log-loss


def test_literal_terms_score_like_the_fitted_model(spark):
    accounts = B.scored(spark, SF_SMALL)
    model, _, _ = M.train_and_evaluate(accounts)
    terms = X.model_terms(model, accounts)
    scaler = next(s for s in model.stages if isinstance(s, X.StandardScalerModel))
    shift = sum(t.weight * m for t, m in zip([t for t in terms if t.level is None], scaler.mean))
    both = M.with_probability(accounts, model, "fitted").withColumn("literal", X.probability(terms, model.stages[-1].intercept - shift))
    assert both.where("fitted IS NULL OR literal IS NULL OR abs(fitted - literal) > 1e-9").count() == 0
    one = spark.createDataFrame([(None, None), (2.0, "x")], "tenure double, region string")
    got = one.select(X.probability([X.Term("tenure", None, 0.5, fill=4.0), X.Term("region", "x", -1.0)], 0.25)).collect()
    assert [round(r[0], 12) for r in got] == [round(1 / (1 + math.exp(-z)), 12) for z in (2.25, 0.25)]
