"""The registered search of boosted trees runs every trial in full, and scores each fold by its own fit."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from churnlens.functions import scratch
from churnlens.operators import evaluation as EV
from churnlens.operators import model as M
from churnlens.plans import base as B
from churnlens.plans.q_model import q_tuned_gbm


@pytest.fixture(scope="module")
def accounts(spark):
    """120 accounts; NULL numbers and categories among them, one id twice."""
    rows = []
    for i in range(120):
        risk = (i * 53 % 120) / 120
        rows.append((f"W{i or 1:03d}", int(risk + (i % 11) / 20 > 0.75), None if i % 31 == 0 else 60 - int(55 * risk), 20.0 + i * 17 % 71,
                     None if i % 23 == 5 else 35.0 + 7 * (i * 13 % 120), ["Two year", "Month-to-month", "One year"][i % 3],
                     None if i % 19 == 0 else ["BUILDING", "MACHINERY"][i % 2], ["ASIA", "AMERICA", "EUROPE"][i * 7 % 3]))
    return spark.createDataFrame(rows, "customer_id string, churned int, tenure int, MonthlyCharges double, TotalCharges double, plan string, "
                                       "segment string, region string").repartition(4, "plan")


def test_registered_search_runs_every_trial_in_full(spark, accounts, monkeypatch):
    asked, real = [], M.GBTClassifier

    def short(**settings):
        asked.append(tuple(round(settings[x], 6) for x in ("stepSize", "maxDepth", "minInstancesPerNode", "maxIter")))
        return real(**{**settings, "maxIter": 1, "maxDepth": 1})

    monkeypatch.setattr(M, "GBTClassifier", short)
    monkeypatch.setattr(B, "scored", lambda *_: accounts)
    out = q_tuned_gbm(spark, "").collect()
    assert [r["trial"] for r in out] == list(range(20))
    assert all(0.01 <= r["step_size"] <= 0.3 and 3 <= r["max_depth"] <= 6 and 10 <= r["min_instances"] <= 100 and 100 <= r["max_iter"] <= 400 for r in out)
    assert Counter(asked) == {(r["step_size"], r["max_depth"], r["min_instances"], r["max_iter"]): 3 for r in out}


def test_search_gives_the_auc_of_whole_pipelines_fitted_apart(spark, accounts, monkeypatch):
    folders = []
    monkeypatch.setattr(scratch, "folder", lambda *a, make=scratch.folder: folders.append(make(*a)) or folders[-1])
    got = M.tune_gbm(accounts, n_trials=2, k=2, iter_range=(2, 6)).collect()
    rnd, folded, want = random.Random(42), M.packed(M.with_folds(accounts, 2), "churned", *M.NUMERIC, *M.CATEGORICAL, "fold"), []
    for _ in range(2):
        step, depth, least, n = math.exp(rnd.uniform(math.log(0.01), math.log(0.3))), rnd.randint(3, 6), rnd.randint(10, 100), rnd.randint(2, 6)
        aucs = []
        for f in range(2):
            model = M.gbt_pipeline(max_iter=n, max_depth=depth, step=step, min_instances=least).fit(folded.where(F.col("fold") != f))
            p = M.with_probability(folded.where(F.col("fold") == f), model, "churn_probability")
            aucs.append(EV.roc_auc(p.withColumn("churn_probability", F.round("churn_probability", 6))).first()[0])
        want.append((round(step, 6), depth, least, n, pytest.approx(sum(aucs) / 2, abs=1e-6)))
    assert [(r["step_size"], r["max_depth"], r["min_instances"], r["max_iter"], r["cv_auc"]) for r in got] == want
    searched = [f for f in folders if "trial-scores" in f]
    assert len(searched) == 1 and not os.path.exists(searched[0].removeprefix("file:"))
