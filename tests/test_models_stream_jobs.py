import os
import tempfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.operators import cox as CX
from churnlens.operators import model as M
from churnlens.operators.explain import linear_reasons
from churnlens.plans import base as B
from churnlens.plans.jobs import decision_request, run_batch_job
from churnlens.sources import sinks

from paths import SF_SMALL


@pytest.fixture(scope="module")
def accounts(spark):
    return B.scored(spark, SF_SMALL)


def test_stratified_split_is_exact_and_disjoint(accounts):
    train, test = M.stratified_split(accounts, 0.2)
    n = {r["churned"]: r["count"] for r in accounts.groupBy("churned").count().collect()}
    t = {r["churned"]: r["count"] for r in test.groupBy("churned").count().collect()}
    import math
    assert all(t[k] == math.ceil(0.2 * n[k]) for k in n)
    assert train.join(test, "customer_id").count() == 0


def test_lr_fits_and_beats_chance(accounts):
    model, holdout, metrics = M.train_and_evaluate(accounts)
    m = metrics.collect()[0]
    assert m["roc_auc"] > 0.5 and 0 <= m["brier_score"] <= 1
    p = [r["churn_probability"] for r in holdout.collect()]
    assert all(0 <= x <= 1 for x in p)
    imp = M.feature_importances(model).collect()
    mags = [abs(r["coefficient"]) for r in imp]
    assert mags == sorted(mags, reverse=True)
    reasons = linear_reasons(model, accounts.limit(20)).collect()
    assert len(reasons) == 20 and all(r["decision_reason"] for r in reasons)
    assert not any("gender" in r["decision_reason"] for r in reasons)


def test_model_save_load_roundtrip_and_missing(spark, accounts):
    model, _, _ = M.train_and_evaluate(accounts)
    d = tempfile.mkdtemp()
    path = sinks.save_model(model, os.path.join(d, "m"))
    again = sinks.load_model(spark, path)
    a = model.transform(accounts).select("customer_id", "probability").collect()
    b = again.transform(accounts).select("customer_id", "probability").collect()
    assert a == b
    with pytest.raises(FileNotFoundError, match="pipeline"):
        sinks.load_model(spark, os.path.join(d, "missing"))


def test_cox_tie_sums_equal_the_sums_over_events():
    for r, e, d in [(10.0, 3.0, 1), (10.0, 3.0, 4), (7.5, 7.5, 9), (1e6, 2.5, 3), (5e3, 900.0, 700), (0.02, 0.01, 50)]:
        u = r - np.arange(d) / d * e
        want = np.log(u).sum(), (1 / u).sum(), (1 / u ** 2).sum()
        assert np.allclose(CX.tie_sums(r, e, d), want, rtol=1e-8, atol=1e-12)
    began = time.time()
    CX.tie_sums(3e7, 1e7, 10_000_000)
    assert time.time() - began < 0.1


def test_cox_derivatives():
    """Gradient and Hessian against the sums over events and finite differences."""
    rng = np.random.default_rng(4)
    x, t, ev = rng.normal(size=(400, 3)), rng.integers(0, 12, 400), rng.random(400) < 0.6

    def stats(beta):
        up, rows = CX._upper(3), []
        for at in range(12):
            row = []
            for use in (t == at, (t == at) & ev):
                w, v = np.exp(x[use] @ beta), x[use]
                sums = [w.sum(), *(w[:, None] * v).sum(0), *[(w * v[:, i] * v[:, j]).sum() for i, j in up]]
                row += [use.sum(), *sums] if not row else [use.sum(), *v.sum(0), *sums]
            rows.append(row)
        return CX._efron(beta, np.arange(12), np.array(rows, float), 3, up, 400, 0.01)

    def likelihood(beta):
        w, total = np.exp(x @ beta), 0.0
        for at in range(12):
            dead = (t == at) & ev
            u = w[t >= at].sum() - np.arange(dead.sum()) / max(1, dead.sum()) * w[dead].sum()
            total += (x[dead] @ beta).sum() - np.log(u).sum()
        return total / 400 - 0.005 * beta @ beta

    beta, step = np.array([0.3, -0.2, 0.5]), 1e-5
    f, g, h = stats(beta)
    assert abs(f - likelihood(beta)) < 1e-9
    for k in range(3):
        d = np.eye(3)[k] * step
        assert abs((likelihood(beta + d) - likelihood(beta - d)) / (2 * step) - g[k]) < 1e-6
        assert np.allclose((stats(beta + d)[1] - stats(beta - d)[1]) / (2 * step), h[k], atol=1e-6)


def test_cox_estimates_bounded_and_spread(accounts):
    m = CX.fit_cox(accounts)
    assert m.converged
    out = CX.cox_expected_remaining(accounts, m)
    r = out.agg(F.min("cox_months").alias("lo"), F.max("cox_months").alias("hi")).collect()[0]
    assert 0 < r["lo"] and r["hi"] <= 60
    cmp = CX.cox_vs_km(accounts, m).collect()[0]
    assert cmp["corr_cox_km"] > 0.5


def test_decision_request_validates(accounts):
    with pytest.raises(ValueError):
        decision_request(accounts, budget=-1)
    summary, act = decision_request(accounts, 5000.0, 50, "Aggressive", 0.3)
    s = summary.collect()[0]
    assert s["act_count"] == act.count() <= 50 and s["budget_used"] <= 5000.0
    nets = [r["net_retention_value"] for r in act.collect()]
    assert nets == sorted(nets, reverse=True)


def test_batch_job_end_to_end(spark):
    out = run_batch_job(spark, SF_SMALL, tempfile.mkdtemp(prefix="job-"), folds=2, gbt_iter=2)
    assert out["act_count"] >= 0
    card = sinks.read_model_card(spark, out["model_card"])
    assert card["n"] > 0 and card["feature_importances"]
    assert {"holdout_metrics", "calibration_table", "segment_summary", "profit_threshold", "lifetime_comparison",
            "model_comparison", "calibration_methods", "gbm_tuning"} <= set(card)
    assert {r["model"] for r in card["model_comparison"]} == {"Logistic Regression", "Gradient Boosting"}
    assert len(card["calibration_methods"]) == 3 and card["gbm_tuning"] is None
    assert spark.read.parquet(out["customers"]).select("clv_method").distinct().first()[0] in ("cox", "km")
    from churnlens.operators.decision import EXPORT_COLUMNS
    act = spark.read.option("header", True).csv(out["act_list"])
    assert act.columns == EXPORT_COLUMNS and act.count() == out["act_count"]
    assert all(r["decision_reason"] for r in act.collect())
    with pytest.raises(FileNotFoundError):
        sinks.read_customers(spark, "/nonexistent/customers")


def test_stream_scores_equal_batch(spark, accounts):
    from churnlens.sources.tables import raw_account_view
    from churnlens.streaming.stream import run_scoring_stream
    root = tempfile.mkdtemp(prefix="stream-")
    raw_account_view(spark, SF_SMALL).drop("last_order", "as_of").repartition(3, "customerID") \
        .write.parquet(os.path.join(root, "in"))
    scores, drift = run_scoring_stream(spark, os.path.join(root, "in"), accounts, os.path.join(root, "out"),
                                       os.path.join(root, "ck"), max_files_per_trigger=1)
    cols = ["customer_id", "CLV", "churn_probability", "risk_band"]
    assert sorted(scores.select(*cols).collect()) == sorted(accounts.select(*cols).collect())
    assert drift.select("batch_id").distinct().count() == 3


def test_cox_step_is_zero_at_the_fit(accounts):
    """The gradient vanishes at the fitted coefficients, and the given ones give the fit's own baseline."""
    m = CX.fit_cox(accounts)
    again, rows = CX.cox_at(accounts, dict(zip(m.names, m.beta)))
    assert [name for name, *_ in rows] == m.names and max(abs(g) for _, g, _ in rows) < 1e-6
    assert all(c < 0 for *_, c in rows) and np.allclose(again.h0, m.h0, rtol=1e-9)
    assert np.all(np.diff(m.h0) >= 0)


def test_cox_covariates_are_parameters(accounts):
    m = CX.fit_cox(accounts, ["MonthlyCharges"], ["segment"])
    assert m.names[0] == "MonthlyCharges" and all(n.startswith("segment_") for n in m.names[1:])
    # all covariates have deviation 1, dummies too
    shown = accounts.select(*[F.stddev_samp(x) for x in m.design(accounts, ["MonthlyCharges"], ["segment"])]).first()
    assert np.allclose(shown, 1.0)
    out = CX.cox_expected_remaining_checked(accounts, numeric=["MonthlyCharges"], categorical=["segment"])
    assert out is None or out.where("expected_months <= 0").count() == 0


def test_several_models_score_one_scan(accounts):
    from churnlens.operators import model as M
    from churnlens.operators import uplift as U
    from churnlens.sources.tables import experiment_frame
    e = experiment_frame(accounts).select("customer_id", "treat", "outcome", *M.NUMERIC, *M.CATEGORICAL)
    twice = e.unionAll(e.limit(5))           # repeated ids stay single rows
    both = U.response_propensity(U.two_model_uplift(twice, M.NUMERIC, M.CATEGORICAL, gbt_iter=2), M.NUMERIC, M.CATEGORICAL, gbt_iter=2)
    assert both.count() == twice.count()
    flat = accounts.checkpoint()             # its own joins are not in question
    assert "Join" not in M.compare_calibration(flat)._jdf.queryExecution().optimizedPlan().toString()
    assert {"p_t", "p_c", "uplift", "propensity"} <= set(both.columns)
