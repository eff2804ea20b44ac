"""End-to-end batch job and the decision-request job.

``run_batch_job``: account view -> quality gate -> economics -> account table
(written, then read back) with the lifetime estimates compared with Kaplan-Meier's -> feature table
-> LR fit on a stratified split -> bake-off, calibration methods and, with ``--tune``, the search of
boosted-tree settings -> model + model card -> model-scored decision with model-based reasons -> ACT
export. Run with ``spark-submit``:

    spark-submit -m churnlens.plans.jobs --sf-dir <input> --out <shared folder> [--tune]
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens import config as C
from churnlens.functions.columns import fixed
from churnlens.operators import decision as D
from churnlens.operators import evaluation as EV
from churnlens.operators import model as M
from churnlens.operators import summaries as S
from churnlens.operators.economics import add_economic_fields, add_score_columns
from churnlens.operators.explain import model_reasons
from churnlens.operators.survival import km_curve, km_remaining
from churnlens.sources import sinks
from churnlens.sources.quality import validate_customers
from churnlens.sources.tables import account_view


def decision_request(scored: DataFrame, budget: float = 25_000.0, max_customers: int | None = 300,
                     strategy: str = "Balanced", save_rate: float = 0.30) -> tuple[DataFrame, DataFrame]:
    """Validated request -> (summary row, ACT list). Raises ``ValueError`` on bad input."""
    dec = D.decide(scored, D.DecisionParams(budget, max_customers, strategy, save_rate))
    return D.decision_response(dec), D.act_list(dec)


def lifetime_comparison(econ: DataFrame) -> DataFrame:
    """Expected months against Kaplan-Meier's per plan: correlation, and the mean spread within a plan
    (1 row)."""
    km = km_remaining(km_curve(econ.select("plan", "tenure", "churned"))).select("plan", "tenure", F.col("expected_months").alias("km"))
    spread = econ.groupBy("plan").agg(F.stddev_samp("expected_months").alias("s")).select(F.avg("s")).scalar()
    return (econ.join(F.broadcast(km), ["plan", "tenure"])          # <= 3 x 161 rows
            .agg(fixed(F.corr("expected_months", "km"), 6).alias("corr_with_km"))
            .select("corr_with_km", fixed(spread, 6).alias("within_plan_spread")))


def run_batch_job(spark: SparkSession, sf_dir: str, out_dir: str, method: str = C.CLV_METHOD, tune: bool = False, folds: int = 5,
                  gbt_iter: int = M.GBT_ITERATIONS, trials: int = 20, numeric=M.NUMERIC, categorical=M.CATEGORICAL) -> dict:
    accounts = validate_customers(account_view(spark, sf_dir))
    econ = add_economic_fields(accounts, method=method)
    table = sinks.write_customers(econ, os.path.join(out_dir, "customers"))
    customers = sinks.read_customers(spark, table).persist()
    lists = {"numeric": numeric, "categorical": categorical}
    features = M.feature_table(customers, **lists)

    model, holdout, metrics = M.train_and_evaluate(features, **lists)
    model_path = sinks.save_model(model, os.path.join(out_dir, "model"))

    def rows_of(df):
        return df.select(F.collect_list(F.struct(*df.columns))).scalar()

    tuning = rows_of(M.tune_gbm(features, n_trials=trials, **lists)) if tune else F.lit(None).cast("array<string>")
    card = S.churn_overall(customers).select(
        "n", "churn_rate",
        metrics.select(F.struct(*metrics.columns)).scalar().alias("holdout_metrics"),
        rows_of(EV.calibration_table(holdout)).alias("calibration_table"),
        rows_of(M.feature_importances(model, **lists)).alias("feature_importances"),
        EV.profit_threshold(EV.profit_curve(holdout)).select(F.struct("*")).scalar().alias("profit_threshold"),
        rows_of(S.churn_summary(customers)).alias("segment_summary"),
        lifetime_comparison(customers).select(F.struct("*")).scalar().alias("lifetime_comparison"),
        rows_of(M.compare_models(features, folds, gbt_iter=gbt_iter, **lists)).alias("model_comparison"),
        rows_of(M.compare_calibration(features, **lists)).alias("calibration_methods"),
        tuning.alias("gbm_tuning"))
    card_path = sinks.write_model_card(card, os.path.join(out_dir, "model_card"))

    p = M.positive_probability(model.transform(customers), "churn_probability")
    scored = add_score_columns(p.select(*customers.columns, fixed("churn_probability", 6).alias("churn_probability")))
    dec = D.decide(scored, D.DecisionParams(), reasons=model_reasons(model, **lists))
    act_path = sinks.export_act_list(D.act_export(dec), os.path.join(out_dir, "act_list"))
    out = D.decision_response(dec).collect()[0].asDict()
    customers.unpersist()
    return {"customers": table, "model": model_path, "model_card": card_path, "act_list": act_path, **out}


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__)
    ap.add_argument("--sf-dir", required=True)
    ap.add_argument("--out", required=True)
    ap.add_argument("--method", default=C.CLV_METHOD, choices=["km", "cox"])
    ap.add_argument("--tune", action="store_true")
    args = ap.parse_args(argv)
    from churnlens.session import ensure_checkpoint_dir
    spark = SparkSession.builder.appName("churnlens-batch").getOrCreate()  # master and sizes come from the submit command
    ensure_checkpoint_dir(spark)
    print(run_batch_job(spark, args.sf_dir, args.out, args.method, args.tune))


if __name__ == "__main__":
    main()
