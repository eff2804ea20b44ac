"""Additive value-count states, slice reductions and the gated stream."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.functions.quantiles import quantiles
from churnlens.operators import drift as DR
from churnlens.operators import evaluation as EV
from churnlens.operators import uplift as U
from paths import SF_SMALL


@pytest.fixture(scope="module")
def pair(spark):
    rng = np.random.default_rng(3)
    schema = "x double, y double, s string"
    rows = lambda n, shift: [(float(rng.integers(0, 40) + shift), None if rng.random() < 0.1 else float(rng.normal()),
                              str(rng.choice(["a", "b", "c"]))) for _ in range(n)]
    return spark.createDataFrame(rows(700, 0), schema).repartition(4), spark.createDataFrame(rows(500, 4) + [(None, None, None)], schema)


def plain_drift(ref, cur):
    ref, cur = ref[~np.isnan(ref)], cur[~np.isnan(cur)]
    edges = np.unique(np.quantile(ref, np.linspace(0, 1, 11)))[1:-1]
    shares = [np.maximum(np.bincount(np.searchsorted(edges, v, side="right"), minlength=len(edges) + 1) / len(v), 1e-6) for v in (ref, cur)]
    every = np.unique(np.r_[ref, cur])
    apart = max(abs((ref <= v).mean() - (cur <= v).mean()) for v in every)
    return float(((shares[1] - shares[0]) * np.log(shares[1] / shares[0])).sum()), float(apart)


def test_drift_equals_plain_numbers_and_scans_each_side_once(spark, pair):
    ref, cur = pair
    seen = spark.sparkContext.accumulator(0)

    def watch(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    watched = [df.mapInPandas(watch, df.schema) for df in pair]
    report = {r["feature"]: r for r in DR.drift_report(*watched, ["x", "y"], ["s"]).collect()}
    assert seen.value == ref.count() + cur.count()
    for c in ("x", "y"):
        psi, apart = plain_drift(*[np.array(df.select(c).toPandas()[c], float) for df in pair])
        assert abs(report[c]["psi"] - psi) < 6e-4
        assert abs(DR.ks_statistic(ref, cur, [c]).first()["ks_d"] - apart) < 1e-9
    assert report["s"]["type"] == "categorical" and not report["s"]["drift"]


def test_states_add_up_and_reports_share_jobs(pair):
    ref, cur = pair
    whole = DR.value_state(ref.unionByName(cur), ["x"], ["s"])
    merged = DR.merge_states(DR.value_state(ref, ["x"], ["s"]), DR.value_state(cur, ["x"], ["s"]))
    assert sorted(map(str, whole.collect())) == sorted(map(str, merged.collect()))
    profile = DR.ReferenceProfile(ref, ["x"], ["s"])
    both = DR.drift_reports(profile, {"one": DR.value_state(cur, ["x"], ["s"]), "self": profile.state}).collect()
    alone = {tuple(r) for r in DR.drift_report_vs(profile, cur).collect()}
    assert {tuple(r)[1:] for r in both if r["label"] == "one"} == alone
    assert not any(r["drift"] for r in both if r["label"] == "self")


def test_quantiles_and_rank_statistics_over_many_partitions(spark):
    rng = np.random.default_rng(8)
    p = rng.integers(0, 60, 900) / 60
    y = (rng.random(900) < p).astype(int)
    df = spark.createDataFrame([(f"c{i}", float(a), int(b), int(i % 2), "g" if i % 3 else None) for i, (a, b) in enumerate(zip(p, y))],
                               "customer_id string, churn_probability double, churned int, treat int, grp string")
    levels = [0.0, 0.1, 0.33, 0.5, 0.99, 1.0]
    got = quantiles(df.select(F.lit("f").alias("feature"), F.col("churn_probability").alias("x")), levels).first()["q"]
    assert np.allclose(got, np.quantile(p, levels))
    pairs = (p[y == 1][:, None] > p[y == 0]).sum() + 0.5 * (p[y == 1][:, None] == p[y == 0]).sum()
    assert abs(EV.roc_auc(df).first()[0] - pairs / (y.sum() * (1 - y).sum())) < 1e-6
    renamed = df.select("customer_id", F.col("churn_probability").alias("score"), "treat", F.col("churned").alias("outcome"), "grp")
    assert U.qini_summary(renamed).collect() == U.qini_coefficient(U.qini_curve(renamed)).collect()
    by = [sorted(map(str, f.collect())) for f in (U.qini_summary(renamed.where("grp = 'g'"), by=["grp"]),
                                                  U.qini_coefficient(U.qini_curve(renamed.where("grp = 'g'"), by=["grp"]), by=["grp"]))]
    assert by[0] == by[1] and len(by[0]) == 1
    assert U.qini_summary(renamed.where(F.lit(False))).first()["n"] == 0


def test_stream_quarantines_bad_rows_and_counts_replays_once(spark):
    from churnlens.plans import base as B
    from churnlens.sources.tables import raw_account_view
    from churnlens.streaming import stream as ST
    root = tempfile.mkdtemp(prefix="gated-")
    accounts = B.scored(spark, SF_SMALL)
    raw = raw_account_view(spark, SF_SMALL).drop("last_order", "as_of")
    good = raw.collect()
    bad = [{**good[0].asDict(), "customerID": "bad-tenure", "tenure": 200}, {**good[1].asDict(), "customerID": None},
           {**good[2].asDict(), "customerID": "twin"}, {**good[2].asDict(), "customerID": "twin", "MonthlyCharges": -1.0}]
    half = len(good) // 2
    for name, part in (("a", [r.asDict() for r in good[:half]] + bad[:2]), ("b", [r.asDict() for r in good[half:]] + bad[2:])):
        spark.createDataFrame([tuple(r[c] for c in raw.columns) for r in part], raw.schema).coalesce(1).write.parquet(f"{root}/parts/{name}")
    os.makedirs(f"{root}/in")
    for name in ("a", "b"):
        src = next(f for f in os.listdir(f"{root}/parts/{name}") if f.endswith(".parquet"))
        os.link(f"{root}/parts/{name}/{src}", f"{root}/in/{name}.parquet")
    scores, drift = ST.run_scoring_stream(spark, f"{root}/in", accounts, f"{root}/out", f"{root}/ck", max_files_per_trigger=1)
    cols = ["customer_id", "CLV", "churn_probability"]
    assert sorted(scores.select(*cols).collect()) == sorted(accounts.select(*cols).collect())
    held = {(r["customerID"], tuple(r["broken_rules"])) for r in spark.read.parquet(f"{root}/out/quarantine").collect()}
    assert held == {("bad-tenure", ("tenure_in_0_100",)), (None, ("customer_id_not_null",)), ("twin", ("customer_id_unique",)),
                    ("twin", ("customer_id_unique", "monthly_charges_gt_0"))}
    # batch 1 again, as after a failure that struck before its progress was noted
    again = "b" if spark.read.parquet(f"{root}/out/quarantine/batch_id=1").where("customerID = 'twin'").count() else "a"
    profile = DR.ReferenceProfile(accounts.select(*ST.NUMERIC, *ST.CATEGORICAL), ST.NUMERIC, ST.CATEGORICAL)
    ST.process_batch(spark.read.parquet(f"{root}/in/{again}.parquet"), 1, ST.km_lookup(accounts), profile, f"{root}/out")
    last = spark.read.parquet(f"{root}/out/running/batch_id=1")
    expected = DR.value_state(accounts, ST.NUMERIC, ST.CATEGORICAL)
    assert sorted(map(str, last.select(*expected.columns).collect())) == sorted(map(str, expected.collect()))
    running = spark.read.parquet(f"{root}/out/drift_running/batch_id=1")
    assert running.count() == 6 and not running.where("drift").count()
