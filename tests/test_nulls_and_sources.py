"""NULL groups and inputs in running sums, columns by name, empty features, large counts."""
from collections import defaultdict

from pyspark.sql import functions as F

from churnlens.functions.columns import fixed
from churnlens.functions.prefix import RangeOrdered
from churnlens.operators.drift import ReferenceProfile, ks_vs, psi_numeric_vs
from churnlens.operators.evaluation import roc_auc
from churnlens.sources.tables import read_customer_csv


def test_running_sums_with_nulls(spark):
    rows = [(k, None if k % 7 == 0 else f"g{k % 2}", None if k % 5 == 0 else k) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, g string, v int").repartition(6)
    run = RangeOrdered(df, [F.col("k").asc()], partition_by=["g"], num_partitions=5).running({"s": F.col("v")}).collect()
    total, count, want = defaultdict(int), defaultdict(int), {}
    for k, g, v in rows:
        total[g] += v or 0
        count[g] += 1
        want[k] = (count[g], total[g])
    assert {r.k: (r.rn, r.s) for r in run} == want


def test_nan_has_no_rounded_value(spark):
    got = spark.createDataFrame([(float("nan"),), (1.234,), (None,)], "x double").select(fixed("x", 2).alias("y")).collect()
    assert [r.y for r in got] == [None, 1.23, None]


def test_auc_of_large_counts(spark):
    big = 3_000_000_000
    df = spark.createDataFrame([(0.2, 1 - big), (0.8, big)], "churn_probability double, churned long")
    assert roc_auc(df).first()[0] is not None


def test_customer_csv_by_name(spark, tmp_path):
    header = ("customerID,gender,SeniorCitizen,Partner,Dependents,tenure,PhoneService,MultipleLines,InternetService,"
              "OnlineSecurity,OnlineBackup,DeviceProtection,TechSupport,StreamingTV,StreamingMovies,Contract,"
              "PaperlessBilling,PaymentMethod,MonthlyCharges,TotalCharges,Churn").split(",")
    values = dict(zip(header, (f"v{k}" for k in range(len(header)))))
    values.update(customerID="Z-1", tenure="7", Contract="One year", MonthlyCharges="12.5", TotalCharges=" ", Churn="Yes")
    names = header[::-1]
    path = tmp_path / "raw.csv"
    path.write_text(",".join(names) + "\n" + ",".join(values[n] for n in names) + "\n")
    row = read_customer_csv(spark, str(path)).first()
    assert (row.customerID, row.tenure, row.Contract, row.MonthlyCharges, row.Churn, row.gender) == (
        "Z-1", 7, "One year", 12.5, "Yes", values["gender"])


def test_feature_without_values_is_drift(spark):
    ref = spark.createDataFrame([(float(k),) for k in range(100)], "x double")
    cur = ref.withColumn("x", F.lit(None).cast("double"))
    profile = ReferenceProfile(ref, ["x"], [])
    assert psi_numeric_vs(profile, cur).first()["psi"] > 0.25
    assert ks_vs(profile, cur).first()["ks_pvalue"] == 0.0
