"""Readers for the input tables and the derived account / experiment / drift views.

The driver's tables are an order-history star schema. The *account view* turns
them into the retention domain: one row per customer with orders, with
right-censored tenure (months from first order to the last order if the customer
lapsed, else to the as-of date), a churn label (no order for a year before the
as-of date) and charges derived from order value.

Scale notes: ``orders`` is aggregated by customer with partial (map-side)
aggregation before the shuffle, so a customer holding a third of all orders
costs one partial row per input partition. ``as_of`` is a scalar subquery (one
tiny aggregate, no join). Dimension tables are joined by key and left to AQE,
which broadcasts them only when their measured size is under the threshold.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from churnlens import config as C
from churnlens.functions.columns import cents, hash_u32

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# Columns of the raw customer CSV format the cleaning operators accept.
RAW_SCHEMA = T.StructType([
    T.StructField("customerID", T.StringType()),
    T.StructField("Contract", T.StringType()),
    T.StructField("segment", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("tenure", T.IntegerType()),
    T.StructField("MonthlyCharges", T.DoubleType()),
    T.StructField("TotalCharges", T.StringType()),
    T.StructField("Churn", T.StringType()),
])


# Columns of the e-mail A/B-test CSV the uplift operators accept.
EXPERIMENT_SCHEMA = T.StructType([
    T.StructField("recency", T.IntegerType()), T.StructField("history_segment", T.StringType()),
    T.StructField("history", T.DoubleType()), T.StructField("mens", T.IntegerType()),
    T.StructField("womens", T.IntegerType()), T.StructField("zip_code", T.StringType()),
    T.StructField("newbie", T.IntegerType()), T.StructField("channel", T.StringType()),
    T.StructField("segment", T.StringType()), T.StructField("visit", T.IntegerType()),
    T.StructField("conversion", T.IntegerType()), T.StructField("spend", T.DoubleType()),
])
EXPERIMENT_NUMERIC = ["recency", "history", "mens", "womens", "newbie"]
EXPERIMENT_CATEGORICAL = ["history_segment", "zip_code", "channel"]


def read_experiment_csv(spark: SparkSession, path: str) -> DataFrame:
    """A/B-test CSV: ``treat`` = any e-mail sent (segment is not the no-e-mail
    control), ``outcome`` = site visit; a row id is attached for rankings."""
    df = _by_name(spark.read.option("header", True).csv(path), EXPERIMENT_SCHEMA)
    same = Window.partitionBy(*df.columns).orderBy(F.lit(0))  # equal rows are told apart by a number
    row = F.concat_ws("-", F.hex(F.xxhash64(*df.columns)), F.row_number().over(same).cast("string"))
    return (df.withColumn("customer_id", F.concat(F.lit("X-"), row))
            .withColumn("treat", F.when(F.col("segment") != "No E-Mail", 1).otherwise(0))
            .withColumn("outcome", F.col("visit").cast("int")))


def _by_name(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns by their header names, cast to the schema's types where it names them
    (NULL where the text does not parse); the other columns stay text."""
    types = {f.name: f.dataType for f in schema.fields}
    return raw.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`")
                        for c in raw.columns])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_customer_csv(spark: SparkSession, path: str,
                      schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Raw customer CSV in any column order, also with columns beyond the schema
    (such as the full 21-column file); no inference pass."""
    return _by_name(spark.read.option("header", True).csv(path), schema)


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-customer order aggregates plus the global as-of date."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderdate", "o_totalprice")
    as_of = orders.select(F.max("o_orderdate")).scalar()
    return (orders.groupBy("o_custkey")
            .agg(F.min("o_orderdate").alias("first_order"),
                 F.max("o_orderdate").alias("last_order"),
                 F.count(F.lit(1)).alias("n_orders"),
                 F.sum(cents("o_totalprice")).alias("spend_cents"))
            .withColumn("as_of", as_of))


def raw_account_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account view in the raw CSV layout (string TotalCharges, Yes/No label)."""
    hist = order_history(spark, sf_dir)
    customer = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")

    churned = F.col("last_order") < (F.col("as_of") - F.expr(f"INTERVAL {C.CHURN_GAP_DAYS} DAYS"))
    end = F.when(churned, F.col("last_order")).otherwise(F.col("as_of"))
    days = F.datediff(end, F.col("first_order"))
    monthly = F.floor(F.col("spend_cents").cast("double")
                      / (F.col("n_orders") * F.lit(2500)) + F.lit(0.5)) / F.lit(100.0)
    total = F.floor(F.col("spend_cents").cast("double") / F.lit(2500)
                    + F.lit(0.5)) / F.lit(100.0)
    plan = (F.when(F.col("n_orders") <= 8, "Month-to-month")
            .when(F.col("n_orders") <= 12, "One year").otherwise("Two year"))

    return (customer
            .join(hist.hint("merge"), customer.c_custkey == hist.o_custkey)  # both sides grow: neither is broadcast
            .join(nation, customer.c_nationkey == nation.n_nationkey)
            .join(region, nation.n_regionkey == region.r_regionkey)
            .select(F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("customerID"),
                    plan.alias("Contract"),
                    F.col("c_mktsegment").alias("segment"),
                    F.col("r_name").alias("region"),
                    F.floor(days / F.lit(30)).cast("int").alias("tenure"),
                    monthly.alias("MonthlyCharges"),
                    total.cast("string").alias("TotalCharges"),
                    F.when(churned, "Yes").otherwise("No").alias("Churn"),
                    "last_order", "as_of"))


def account_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned, validated account table (see ``sources.quality.clean_customers``)."""
    from churnlens.sources.quality import clean_customers
    return clean_customers(raw_account_view(spark, sf_dir))


def experiment_frame(accounts: DataFrame) -> DataFrame:
    """A/B-style frame from an account table: ``treat`` = parity of the md5 of
    the id, ``outcome`` = an order in the last 90 days before the as-of date."""
    recent = F.col("last_order") >= (F.col("as_of") - F.expr(f"INTERVAL {C.EXPERIMENT_RECENT_DAYS} DAYS"))
    return (accounts.withColumn("treat", (hash_u32(F.col("customer_id")) % 2).cast("int"))
            .withColumn("outcome", F.when(recent, 1).otherwise(0)))


def experiment_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return experiment_frame(account_view(spark, sf_dir)).select("customer_id", "treat", "outcome")


def drift_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reference = orders before the split date, current = from it on."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderstatus")
    split = F.lit(C.DRIFT_SPLIT_DATE).cast("timestamp_ntz")
    return (orders.where(F.col("o_orderdate") < split),
            orders.where(F.col("o_orderdate") >= split))
