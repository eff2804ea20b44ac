import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    scratch = tempfile.mkdtemp(prefix="churnlens-test-")
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", os.path.join(scratch, "ckpt"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def raw_customers(spark):
    """Raw customer records: every plan, churned and not, no tenure, blank totals."""
    rows = [
        ("K01", "Two year", 71, 118.35, "8402.9", "No"),
        ("K02", "Month-to-month", 2, 19.9, "39.8", "Yes"),
        ("K03", "One year", 17, 54.1, "919.7", "No"),
        ("K04", "Month-to-month", 0, 33.3, "", "No"),
        ("K05", "Two year", 0, 64.0, "  ", "No"),
        ("K06", "One year", 44, 88.8, "3907.2", "Yes"),
        ("K07", "Month-to-month", 9, 74.6, "671.4", "No"),
        ("K08", "Month-to-month", 26, 101.5, "2639.0", "Yes"),
        ("K09", "Two year", 55, 21.4, "1177.0", "No"),
    ]
    return spark.createDataFrame(
        [(i, c, "AUTOMOBILE", "ASIA", t, m, tot, ch) for i, c, t, m, tot, ch in rows],
        "customerID string, Contract string, segment string, region string, tenure int, "
        "MonthlyCharges double, TotalCharges string, Churn string")


@pytest.fixture(scope="session")
def scored_frame(spark):
    """72 scored rows on lattices without a common period: risk, value and cost are unrelated."""
    rows = []
    for i in range(72):
        p = (1 + i * 29 % 72) / 74
        rows.append((f"S-{i}", p, 240.0 + i * i * 61 % 5300, 22.0 + i * 43 % 97 + i % 4 / 4,
                     "HIGH" if p >= 0.6 else "MEDIUM" if p >= 0.3 else "LOW", "One year" if i % 3 else "Month-to-month", i % 25))
    return spark.createDataFrame(rows, "customer_id string, churn_probability double, CLV double, "
                                       "retention_cost double, risk_band string, plan string, tenure int")
