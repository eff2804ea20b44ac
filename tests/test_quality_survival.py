import pytest
from pyspark.sql import functions as F

from churnlens.operators.survival import km_curve, km_remaining
from churnlens.sources.quality import clean_customers, dq_violations, validate_customers


def test_clean_coerces_blank_total_and_maps_label(raw_customers):
    df = clean_customers(raw_customers)
    rows = {r["customer_id"]: r for r in df.collect()}
    assert rows["K04"]["TotalCharges"] == rows["K05"]["TotalCharges"] == 0.0
    assert rows["K02"]["churned"] == 1 and rows["K03"]["churned"] == 0
    assert "Churn" not in df.columns and "customerID" not in df.columns


def test_missing_column_raises(raw_customers):
    with pytest.raises(ValueError, match="Contract"):
        clean_customers(raw_customers.drop("Contract"))


def test_empty_input_raises(raw_customers):
    with pytest.raises(ValueError, match="empty"):
        validate_customers(clean_customers(raw_customers.limit(0)))


def test_gate_flags_violations(raw_customers):
    bad = clean_customers(raw_customers).withColumn(
        "tenure", F.when(F.col("customer_id") == "K01", 500).otherwise(F.col("tenure")))
    v = {r["rule"]: r["violations"] for r in dq_violations(bad.unionByName(bad.limit(1))).collect()}
    assert v["tenure_in_0_100"] >= 1
    assert v["customer_id_unique"] == 2
    assert validate_customers(clean_customers(raw_customers)) is not None


def test_kaplan_meier_hand_computed(spark):
    df = spark.createDataFrame([("g", d, e) for d, e in zip([1, 2, 3, 4, 5], [1, 0, 1, 1, 0])],
                               "plan string, tenure int, churned int")
    s = [round(r["surv"], 4) for r in km_curve(df).orderBy("t").collect()]
    assert s == [0.8, 0.8, 0.5333, 0.2667, 0.2667]


def test_km_remaining_bounded_and_step_lookup(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    rows = [("g", int(d), int(e)) for d, e in zip(rng.integers(1, 60, 200), rng.integers(0, 2, 200))]
    df = spark.createDataFrame(rows, "plan string, tenure int, churned int")
    curve = km_curve(df).orderBy("t").collect()
    surv = [r["surv"] for r in curve]
    assert all(a >= b for a, b in zip(surv, surv[1:]))
    rem = km_remaining(km_curve(df), horizon=60).collect()
    assert all(0 <= r["expected_months"] <= 60 for r in rem)
    before = [r for r in rem if r["tenure"] == 0][0]
    assert before["surv"] == 1.0  # before the first time S = 1


def test_read_customer_csv_with_schema(spark, raw_customers, tmp_path):
    from churnlens.sources.tables import read_customer_csv
    path = str(tmp_path / "raw_csv")
    raw_customers.coalesce(1).write.option("header", True).csv(path)
    back = clean_customers(read_customer_csv(spark, path))
    assert back.count() == 9
    assert dict(back.dtypes)["TotalCharges"] == "double" and dict(back.dtypes)["tenure"] == "int"
