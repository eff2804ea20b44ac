"""Registered queries: evaluation (AUC, metrics, profit cutoff, calibration),
uplift (Qini, ATE) and drift (PSI, KS, report)."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens import config as C
from churnlens.functions.columns import fixed, hash_u32
from churnlens.operators import drift as DR
from churnlens.operators import evaluation as EV
from churnlens.operators import uplift as U
from churnlens.plans import base as B
from churnlens.plans.oracle import base as sql_base
from churnlens.plans.oracle import dbl, fx, md5_u32, with_ctes
from churnlens.plans.oracle_drift import drift_ctes, report_sql
from churnlens.plans.registry import query
from churnlens.sources.tables import drift_pair, experiment_frame

# ---- G1-G5, G7 -------------------------------------------------------------------------


@query("roc_auc", sql_base(f"""
SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN
  {fx(f'CAST(sum(pos * (2 * (cneg - neg) + neg)) AS DOUBLE) / ({dbl(2.0)} * CAST(sum(pos) AS BIGINT) * CAST(sum(neg) AS BIGINT))', 6)}
  END AS roc_auc
FROM (SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cneg
      FROM (SELECT churn_probability AS score, CAST(sum(churned) AS BIGINT) AS pos,
                   CAST(sum(1 - churned) AS BIGINT) AS neg FROM scored GROUP BY 1))"""))
def q_roc_auc(spark, sf_dir):
    """ROC AUC of the scorecard probability against the churn label (rank statistic)."""
    return EV.roc_auc(B.scored(spark, sf_dir))


_M = "churn_probability >= " + dbl(0.5)
_P = "count(*) FILTER (WHERE {m} AND churned = 1) / (count(*) FILTER (WHERE {m}))".format(m=_M)


@query("classification_metrics", sql_base(f"""
SELECT {fx('(tp + tn) / n', 6)} AS accuracy, {fx('prec', 6)} AS precision_churn, {fx('rec', 6)} AS recall_churn,
       CASE WHEN prec + rec > 0 THEN {fx(f'{dbl(2.0)} * prec * rec / (prec + rec)', 6)} ELSE {dbl(0.0)} END AS f1_churn,
       {fx('brier', 6)} AS brier_score, {fx('mean_p', 6)} AS mean_predicted_prob,
       {fx('max_p', 6)} AS max_predicted_prob, {fx('share_hi', 6)} AS share_prob_ge_060
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE {dbl(0.0)} END AS prec,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE {dbl(0.0)} END AS rec
      FROM (SELECT count(*) AS n,
                   count(*) FILTER (WHERE {_M} AND churned = 1) AS tp,
                   count(*) FILTER (WHERE {_M} AND churned <> 1) AS fp,
                   count(*) FILTER (WHERE NOT ({_M}) AND churned = 1) AS fn,
                   count(*) FILTER (WHERE NOT ({_M}) AND churned <> 1) AS tn,
                   avg((churn_probability - churned) * (churn_probability - churned)) AS brier,
                   avg(churn_probability) AS mean_p, max(churn_probability) AS max_p,
                   avg(CASE WHEN churn_probability >= {dbl(C.RISK_HIGH)} THEN {dbl(1.0)} ELSE {dbl(0.0)} END) AS share_hi
            FROM scored))"""))
def q_classification_metrics(spark, sf_dir):
    """Accuracy, precision, recall, F1 at 0.5, Brier, mean / max probability, share >= 0.60."""
    return EV.classification_metrics(B.scored(spark, sf_dir))


_CUTS = "[" + ", ".join(repr(v) for v in EV.CUTOFFS) + "]::DOUBLE[]"
_PROFIT_CTES = [
    ("pc", f"""
SELECT len(list_filter({_CUTS}, lambda t: t <= churn_probability)) AS b,
       sum(CAST(floor(({dbl(C.SAVE_RATE)} * churned * CLV - retention_cost) * {dbl(1e4)} + {dbl(0.5)}) AS BIGINT)) AS s
FROM scored GROUP BY 1"""),
    ("pk", f"""
SELECT g.k, coalesce(pc.s, 0) AS s FROM (SELECT unnest(range(0, {len(EV.CUTOFFS)})) AS k) g
LEFT JOIN pc ON pc.b = g.k + 1"""),
    ("pv", f"""
SELECT k, k / {dbl(float(C.PROFIT_STEPS))} AS threshold,
       sum(s) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / {dbl(1e4)} AS value FROM pk"""),
]


@query("profit_curve", sql_base(f"SELECT {fx('threshold', 3)} AS threshold, {fx('value', 1)} AS value FROM pv",
                                extra=_PROFIT_CTES))
def q_profit_curve(spark, sf_dir):
    """Realised value of acting on p >= t for the 51 cutoffs 0..1."""
    c = EV.profit_curve(B.scored(spark, sf_dir))
    return c.select(fixed("threshold", 3).alias("threshold"), fixed("value", 1).alias("value"))


@query("profit_threshold", sql_base(f"""
SELECT {fx('first(threshold ORDER BY value DESC, k)', 3)} AS best_threshold, {fx('max(value)', 4)} AS best_value,
       {fx('max(value) FILTER (WHERE k = 25)', 4)} AS value_at_half,
       {fx('max(value) - max(value) FILTER (WHERE k = 25)', 4)} AS gain_over_half FROM pv""", extra=_PROFIT_CTES))
def q_profit_threshold(spark, sf_dir):
    """Profit-maximising cutoff, its value, the value at 0.5 and the gain over the naive cutoff."""
    return EV.profit_threshold(EV.profit_curve(B.scored(spark, sf_dir)))


_LEVELS = "[" + ", ".join(repr(v) for v in EV.DECILE_LEVELS) + "]::DOUBLE[]"


@query("calibration_table", sql_base(f"""
SELECT decile, count(*) AS customers, {fx('avg(churn_probability)', 3)} AS avg_predicted,
       {fx('avg(churned)', 3)} AS actual_churn_rate
FROM (SELECT s.*, len(list_filter(e[2:len(e) - 1], lambda v: v < s.churn_probability)) AS decile
      FROM scored s CROSS JOIN (SELECT list_sort(list_distinct(quantile_cont(churn_probability, {_LEVELS}))) AS e
                                FROM scored))
GROUP BY decile"""))
def q_calibration_table(spark, sf_dir):
    """Predicted vs actual churn by probability decile (duplicate edges dropped)."""
    return EV.calibration_table(B.scored(spark, sf_dir))


# ---- M1-M4 uplift ----------------------------------------------------------------------

_EXP_CTES = [("qx", f"""
SELECT customer_id, churn_probability AS score, CAST({md5_u32('customer_id')} % 2 AS INTEGER) AS treat,
       CASE WHEN last_order >= as_of - INTERVAL {C.EXPERIMENT_RECENT_DAYS} DAY THEN 1 ELSE 0 END AS outcome
FROM scored"""), ("qr", """
SELECT *, row_number() OVER w AS rank, sum(treat) OVER w AS n_t, sum(1 - treat) OVER w AS n_c,
       sum(outcome * treat) OVER w AS r_t, sum(outcome * (1 - treat)) OVER w AS r_c,
       count(*) OVER () AS n
FROM qx WINDOW w AS (ORDER BY score DESC, customer_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    ("qc", f"""
SELECT customer_id, rank, rank / n AS fraction,
       r_t - r_c * (CASE WHEN n_c > 0 THEN n_t / n_c ELSE {dbl(0.0)} END) AS qini, n FROM qr""")]


def _experiment(spark, sf_dir):
    return experiment_frame(B.scored(spark, sf_dir)).withColumnRenamed("churn_probability", "score")


@query("qini_curve", sql_base(f"SELECT customer_id, rank, {fx('fraction', 8)} AS fraction, {fx('qini', 6)} AS qini FROM qc",
                              extra=_EXP_CTES))
def q_qini_curve(spark, sf_dir):
    """Qini curve of the churn-probability ranking on the experiment view."""
    c = U.qini_curve(_experiment(spark, sf_dir))
    return c.select("customer_id", "rank", fixed("fraction", 8).alias("fraction"), fixed("qini", 6).alias("qini"))


_QCOEF = f"""
SELECT count(*) AS n, {fx('max(qini) FILTER (WHERE rank = n)', 6)} AS qini_final,
       {fx('(sum(d) - (max(d) FILTER (WHERE rank = 1) + max(d) FILTER (WHERE rank = n)) / 2) / count(*)', 6)} AS qini_coefficient
FROM (SELECT *, qini - fraction * (SELECT max(qini) FILTER (WHERE rank = n) FROM qc) AS d FROM qc)"""


@query("qini_coefficient", sql_base(_QCOEF, extra=_EXP_CTES))
def q_qini_coefficient(spark, sf_dir):
    """Area between the Qini curve and random targeting."""
    return U.qini_summary(_experiment(spark, sf_dir))


@query("qini_by_ranking", sql_base(f"""
SELECT ranking, count(*) AS n, {fx('max(qini) FILTER (WHERE rank = n)', 6)} AS qini_final,
       {fx('(sum(d) - (max(d) FILTER (WHERE rank = 1) + max(d) FILTER (WHERE rank = n)) / 2) / count(*)', 6)} AS qini_coefficient
FROM (SELECT *, qini - fraction * max(qini) FILTER (WHERE rank = n) OVER (PARTITION BY ranking) AS d
      FROM (SELECT ranking, customer_id, rank, rank / n AS fraction,
                   r_t - r_c * (CASE WHEN n_c > 0 THEN n_t / n_c ELSE {dbl(0.0)} END) AS qini, n
            FROM (SELECT *, row_number() OVER w AS rank, sum(treat) OVER w AS n_t, sum(1 - treat) OVER w AS n_c,
                         sum(outcome * treat) OVER w AS r_t, sum(outcome * (1 - treat)) OVER w AS r_c,
                         count(*) OVER (PARTITION BY ranking) AS n
                  FROM (SELECT 'propensity' AS ranking, customer_id, score, treat, outcome FROM qx
                        UNION ALL
                        SELECT 'random', customer_id, CAST({md5_u32(f"'{C.SEED}|rank|' || customer_id")} AS DOUBLE),
                               treat, outcome FROM qx)
                  WINDOW w AS (PARTITION BY ranking ORDER BY score DESC, customer_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))))
GROUP BY ranking""", extra=_EXP_CTES))
def q_qini_by_ranking(spark, sf_dir):
    """Qini coefficient of two rankings in one pass: churn propensity vs random."""
    e = _experiment(spark, sf_dir)
    prop = e.select(F.lit("propensity").alias("ranking"), "customer_id", "score", "treat", "outcome")
    rnd = e.select(F.lit("random").alias("ranking"), "customer_id",
                   hash_u32(F.lit(f"{C.SEED}|rank|"), F.col("customer_id")).cast("double").alias("score"),
                   "treat", "outcome")
    return U.qini_summary(prop.unionByName(rnd), by=["ranking"])


@query("treatment_effect", sql_base(f"""
SELECT count(*) FILTER (WHERE treat = 1) AS n_treated, count(*) FILTER (WHERE treat <> 1) AS n_control,
       {fx('avg(outcome) FILTER (WHERE treat = 1)', 6)} AS treated_rate,
       {fx('avg(outcome) FILTER (WHERE treat <> 1)', 6)} AS control_rate,
       {fx('avg(outcome) FILTER (WHERE treat = 1) - avg(outcome) FILTER (WHERE treat <> 1)', 6)} AS ate
FROM qx""", extra=_EXP_CTES[:1]))
def q_treatment_effect(spark, sf_dir):
    """Average treatment effect on the experiment view."""
    return U.treatment_effect(_experiment(spark, sf_dir))


# ---- M5-M9 drift ------------------------------------------------------------------------

_SPLIT = f"TIMESTAMP '{C.DRIFT_SPLIT_DATE}'"
_ORD_NUM, _ORD_CAT = ["o_totalprice"], ["o_orderpriority", "o_orderstatus"]
_ORD_CTES = drift_ctes("od_", f"SELECT * FROM orders WHERE o_orderdate < {_SPLIT}",
                       f"SELECT * FROM orders WHERE o_orderdate >= {_SPLIT}", _ORD_NUM, _ORD_CAT)


@query("psi_numeric", with_ctes(_ORD_CTES, f"SELECT feature, {fx('psi', 6)} AS psi FROM od_num"))
def q_psi_numeric(spark, sf_dir):
    """PSI of order value, orders before vs from 1999-01-01."""
    ref, cur = drift_pair(spark, sf_dir)
    return DR.psi_numeric(ref, cur, _ORD_NUM).select("feature", fixed("psi", 6).alias("psi"))


@query("psi_categorical", with_ctes(_ORD_CTES, f"SELECT feature, {fx('psi', 6)} AS psi FROM od_cat"))
def q_psi_categorical(spark, sf_dir):
    """PSI of order priority and status, orders before vs from 1999-01-01."""
    ref, cur = drift_pair(spark, sf_dir)
    return DR.psi_categorical(ref, cur, _ORD_CAT).select("feature", fixed("psi", 6).alias("psi"))


@query("ks_statistic", with_ctes(_ORD_CTES, f"""
SELECT feature, n_ref, n_cur, {fx('ks_d', 8)} AS ks_d, {fx('ks_pvalue', 6)} AS ks_pvalue FROM od_num"""))
def q_ks_statistic(spark, sf_dir):
    """Two-sample KS statistic and asymptotic p-value of order value."""
    ref, cur = drift_pair(spark, sf_dir)
    return DR.ks_statistic(ref, cur, _ORD_NUM).select(
        "feature", "n_ref", "n_cur", fixed("ks_d", 8).alias("ks_d"), fixed("ks_pvalue", 6).alias("ks_pvalue"))


@query("drift_report", with_ctes(_ORD_CTES, report_sql("od_", True, True) + " ORDER BY psi DESC, feature"))
def q_drift_report(spark, sf_dir):
    """Per-feature PSI / KS drift report, worst first."""
    ref, cur = drift_pair(spark, sf_dir)
    return DR.drift_report(ref, cur, _ORD_NUM, _ORD_CAT)


_ACC_NUM = ["tenure", "MonthlyCharges", "TotalCharges"]
_ACC_CAT = ["plan", "segment", "region"]
_ACC_COLS = ", ".join(_ACC_NUM + _ACC_CAT)
_DRIFTED = (f"SELECT tenure, MonthlyCharges * {dbl(1.4)} AS MonthlyCharges, TotalCharges, "
            f"'Month-to-month' AS plan, segment, region FROM scored")
_DEMO_CTES = (drift_ctes("sd_", f"SELECT {_ACC_COLS} FROM scored", f"SELECT {_ACC_COLS} FROM scored", _ACC_NUM, _ACC_CAT)
              + drift_ctes("xd_", f"SELECT {_ACC_COLS} FROM scored", _DRIFTED, _ACC_NUM, _ACC_CAT))


@query("drift_demo", sql_base(
    f"SELECT 'self' AS comparison, * FROM ({report_sql('sd_', True, True)}) "
    f"UNION ALL SELECT 'drifted' AS comparison, * FROM ({report_sql('xd_', True, True)})", extra=_DEMO_CTES))
def q_drift_demo(spark, sf_dir):
    """Account table vs itself (no drift) and vs a drifted copy (charges x1.4, all month-to-month)."""
    ref = B.scored(spark, sf_dir).select(*_ACC_NUM, *_ACC_CAT)
    drifted = ref.withColumn("MonthlyCharges", F.col("MonthlyCharges") * F.lit(1.4)).withColumn(
        "plan", F.lit("Month-to-month"))
    profile = DR.ReferenceProfile(ref, _ACC_NUM, _ACC_CAT)   # one reference profile for both batches
    return DR.drift_reports(profile, {"self": profile.state, "drifted": DR.value_state(drifted, _ACC_NUM, _ACC_CAT)}).select(
        F.col("label").alias("comparison"), "feature", "type", "psi", "ks_pvalue", "drift")
