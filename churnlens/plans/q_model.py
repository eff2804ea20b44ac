"""Registered model queries (Spark ML). No SQL oracle: the driver checks row
counts; ``tests/test_models_stream_jobs.py`` checks behaviour (AUC > 0.5, bounds,
sortedness, save/load round trip).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens import config as C
from churnlens.functions.columns import fixed
from churnlens.operators import decision as D
from churnlens.operators import evaluation as EV
from churnlens.operators import model as M
from churnlens.operators import summaries as S
from churnlens.operators import uplift as U
from churnlens.operators.economics import add_score_columns
from churnlens.operators.explain import linear_reasons
from churnlens.plans import base as B
from churnlens.plans import oracle as O
from churnlens.plans.oracle import md5_u32
from churnlens.plans.registry import query
from churnlens.sources.tables import experiment_frame

_FITTED: dict = {}


def fitted_lr(spark, sf_dir):
    """(model, holdout, metrics) fitted once per session and input folder."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _FITTED:
        model, holdout, metrics = M.train_and_evaluate(B.scored(spark, sf_dir))
        _FITTED[key] = (model, holdout.persist(), metrics)
    return _FITTED[key]


_SPLIT_SQL = f"""
SELECT customer_id, churned, row_number() OVER (PARTITION BY churned ORDER BY {md5_u32(f"'{C.SEED}|' || customer_id")}, customer_id) AS rn,
       count(*) OVER (PARTITION BY churned) AS n FROM scored"""


@query("stratified_holdout", O.base(f"SELECT customer_id, churned, rn <= ceil({O.dbl(0.2)} * n) AS holdout FROM ({_SPLIT_SQL})"))
def q_stratified_holdout(spark, sf_dir):
    """Which accounts are in the stratified 20 % holdout."""
    s = B.scored(spark, sf_dir)
    return s.select("customer_id", "churned", M.in_holdout(s).alias("holdout"))


@query("kfold_assignment", O.base(f"""
SELECT customer_id, churned, CAST({' + '.join(f'CASE WHEN rn > (n * {f} + 4) // 5 THEN 1 ELSE 0 END' for f in range(1, 5))} AS INTEGER) AS fold
FROM ({_SPLIT_SQL})"""))
def q_kfold_assignment(spark, sf_dir):
    """The stratified fold (of five) of every account."""
    return M.with_folds(B.scored(spark, sf_dir), 5).select("customer_id", "churned", "fold")


@query("lr_scores")
def q_lr_scores(spark, sf_dir):
    """Logistic-regression churn probability on the stratified 20 % holdout."""
    return fitted_lr(spark, sf_dir)[1].select("customer_id", "churned", "churn_probability")


@query("lr_holdout_metrics")
def q_lr_holdout_metrics(spark, sf_dir):
    """Holdout AUC, accuracy, precision, recall, F1, Brier of the fitted LR."""
    return fitted_lr(spark, sf_dir)[2]


@query("lr_profit_threshold")
def q_lr_profit_threshold(spark, sf_dir):
    """Profit-maximising cutoff of the fitted LR on the holdout labels."""
    return EV.profit_threshold(EV.profit_curve(fitted_lr(spark, sf_dir)[1]))


@query("lr_calibration_table")
def q_lr_calibration_table(spark, sf_dir):
    """Calibration deciles of the fitted LR on the holdout."""
    return EV.calibration_table(fitted_lr(spark, sf_dir)[1])


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    """Top-12 LR coefficients by absolute value."""
    return M.feature_importances(fitted_lr(spark, sf_dir)[0])


@query("model_bakeoff")
def q_model_bakeoff(spark, sf_dir):
    """Stratified 5-fold LR vs boosted trees: AUC / Brier mean and sd, accuracy, F1."""
    return M.compare_models(B.scored(spark, sf_dir), k=5)


@query("tuned_gbm")
def q_tuned_gbm(spark, sf_dir):
    """Seeded random search of boosted-tree settings by 3-fold AUC (20 trials of 100-400 iterations)."""
    return M.tune_gbm(B.scored(spark, sf_dir))


@query("calibration_methods")
def q_calibration_methods(spark, sf_dir):
    """Brier of raw LR vs isotonic and sigmoid 3-fold calibrated ensembles."""
    return M.compare_calibration(B.scored(spark, sf_dir))


def _model_scored(spark, sf_dir):
    model = fitted_lr(spark, sf_dir)[0]
    scored = B.scored(spark, sf_dir).drop("churn_probability", "risk_band", "loss_if_act", "loss_if_ignore")
    p = M.positive_probability(model.transform(scored), "churn_probability").select(
        *scored.columns, fixed("churn_probability", 6).alias("churn_probability"))
    return add_score_columns(p)


@query("model_decision")
def q_model_decision(spark, sf_dir):
    """Score every account with the fitted LR, then decide (25k, cap 300, Balanced)."""
    return D.decision_response(D.decide(_model_scored(spark, sf_dir), D.DecisionParams()))


@query("linear_reasons")
def q_linear_reasons(spark, sf_dir):
    """Model-attribution reasons for the ACT rows of the model-scored decision."""
    dec = D.decide(_model_scored(spark, sf_dir), D.DecisionParams())
    return linear_reasons(fitted_lr(spark, sf_dir)[0], dec.act)


def _experiment(spark, sf_dir):
    return experiment_frame(B.scored(spark, sf_dir))


@query("uplift_scores")
def q_uplift_scores(spark, sf_dir):
    """Two-model (T-learner) uplift per account on the experiment view."""
    up = U.two_model_uplift(_experiment(spark, sf_dir), M.NUMERIC, M.CATEGORICAL)
    return up.select("customer_id", "treat", "outcome", fixed("p_t", 6).alias("p_treated"),
                     fixed("p_c", 6).alias("p_control"), fixed("uplift", 6).alias("uplift"))


@query("uplift_vs_propensity")
def q_uplift_vs_propensity(spark, sf_dir):
    """Qini coefficient of uplift vs response-propensity vs random ranking."""
    from churnlens.functions.columns import hash_u32
    rows = _experiment(spark, sf_dir)
    *arm_models, all_model = U.outcome_models([*U.arms(rows), rows], M.NUMERIC, M.CATEGORICAL)
    up = U.two_model_uplift(rows, M.NUMERIC, M.CATEGORICAL, models=arm_models)
    both = U.response_propensity(up, M.NUMERIC, M.CATEGORICAL, model=all_model)
    rankings = {"uplift": F.col("uplift"), "propensity": F.col("propensity"),
                "random": hash_u32(F.lit(f"{C.SEED}|rank|"), F.col("customer_id")).cast("double")}
    long = both.select("customer_id", "treat", "outcome", F.inline(F.array(*[
        F.struct(F.lit(name).alias("ranking"), score.alias("score")) for name, score in rankings.items()])))
    return U.qini_summary(long, by=["ranking"])


@query("model_card")
def q_model_card(spark, sf_dir):
    """One-row model card: data size and churn rate, holdout metrics, calibration,
    importances, profit cutoff, churn summary by segment (arrays of structs)."""
    model, holdout, metrics = fitted_lr(spark, sf_dir)
    scored = B.scored(spark, sf_dir)

    def rows_of(df):
        return df.select(F.collect_list(F.struct(*df.columns))).scalar()

    return S.churn_overall(scored).select(
        "n", "churn_rate",
        metrics.select(F.struct(*metrics.columns)).scalar().alias("holdout_metrics"),
        rows_of(EV.calibration_table(holdout)).alias("calibration_table"),
        rows_of(M.feature_importances(model)).alias("feature_importances"),
        EV.profit_threshold(EV.profit_curve(holdout)).select(F.struct("*")).scalar().alias("profit_threshold"),
        rows_of(S.churn_summary(scored)).alias("segment_summary"))


# ---- C5-C8 Cox proportional hazards -----------------------------------------------------

_COX: dict = {}


def fitted_cox(spark, sf_dir):
    from churnlens.operators.cox import fit_cox
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _COX:
        _COX[key] = fit_cox(B.scored(spark, sf_dir))
    return _COX[key]


@query("cox_coefficients")
def q_cox_coefficients(spark, sf_dir):
    """Penalised Cox coefficients (Efron ties, Newton) on standardised covariates."""
    m = fitted_cox(spark, sf_dir)
    rows = [(n, float(b)) for n, b in zip(m.names, m.beta)]  # p model coefficients
    return spark.createDataFrame(rows, "covariate string, coefficient double").select(
        "covariate", fixed("coefficient", 6).alias("coefficient"))


@query("cox_remaining")
def q_cox_remaining(spark, sf_dir):
    """Per-account Cox expected remaining months over the 60-month horizon."""
    from churnlens.operators.cox import cox_expected_remaining
    return cox_expected_remaining(B.scored(spark, sf_dir), fitted_cox(spark, sf_dir)).select(
        "customer_id", "plan", "tenure", "cox_months")


@query("cox_vs_km")
def q_cox_vs_km(spark, sf_dir):
    """Correlation of Cox and KM expected months and the within-plan Cox spread."""
    from churnlens.operators.cox import cox_vs_km
    return cox_vs_km(B.scored(spark, sf_dir), fitted_cox(spark, sf_dir))


@query("cox_economics")
def q_cox_economics(spark, sf_dir):
    """Economics with the method choice: Cox when valid (>= 200 rows, all estimates
    positive), else Kaplan-Meier; the chosen method is reported per row."""
    from churnlens.operators.economics import add_economic_fields
    from churnlens.sources.tables import account_view
    econ = add_economic_fields(account_view(spark, sf_dir), method="cox")
    return econ.select("customer_id", "plan", "clv_method", "expected_months", "CLV", "retention_cost")


# ---- one Cox step and its estimates for coefficients given as literals ------------------

COX_BETA = {"MonthlyCharges": 0.15, "TotalCharges": -0.4, "plan_One year": -0.3, "plan_Two year": -0.5,
            "segment_BUILDING": 0.05, "segment_MACHINERY": -0.1, "region_ASIA": 0.1, "region_EUROPE": -0.05}
_COX_LEVELS = {"plan": ["One year", "Two year"], "segment": ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
               "region": ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]}
_COX_X = {"MonthlyCharges": "MonthlyCharges", "TotalCharges": "TotalCharges",
          **{f"{c}_{lv}": f"CASE WHEN {c} = '{lv}' THEN {O.dbl(1.0)} ELSE {O.dbl(0.0)} END" for c, lvs in _COX_LEVELS.items() for lv in lvs}}
_COX_NAMES = "[" + ", ".join(f"'{name}'" for name in _COX_X) + "]"
_COX_BETAS = "[" + ", ".join(O.dbl(COX_BETA.get(name, 0.0)) for name in _COX_X) + "]"
_COX_CTES = [
    ("cox_raw", f"SELECT customer_id, plan, tenure, churned, {', '.join(f'{x} AS r{k}' for k, x in enumerate(_COX_X.values()))} FROM scored"),
    ("cox_scale", f"SELECT count(*) AS n, {', '.join(f'avg(r{k}) AS m{k}, stddev_samp(r{k}) AS d{k}' for k in range(len(_COX_X)))} FROM cox_raw"),
    ("cox_x", f"SELECT customer_id, plan, tenure, churned, [{', '.join(f'(r{k} - m{k}) / d{k}' for k in range(len(_COX_X)))}] AS x FROM cox_raw, cox_scale"),
    ("cox_w", f"SELECT *, exp(list_dot_product(x, {_COX_BETAS})) AS w FROM cox_x"),
]


@query("cox_step", O.base(f"""
SELECT name AS covariate, {O.fx(f"(max(xs) - sum(a)) / max(n) - {O.dbl(C.COX_PENALIZER)} * max(b)", 6)} AS gradient,
       {O.fx(f"-sum(c - a * a) / max(n) - {O.dbl(C.COX_PENALIZER)}", 6)} AS curvature
FROM (SELECT name, b, n, sum(xs / d) OVER (PARTITION BY name) AS xs, (r1 - l / d * e1) / (r0 - l / d * e0) AS a, (r2 - l / d * e2) / (r0 - l / d * e0) AS c
      FROM (SELECT *, unnest(range(CAST(d AS BIGINT))) AS l FROM cox_r WHERE d > 0), cox_scale)
GROUP BY name""", _COX_CTES + [
    ("cox_long", f"SELECT tenure, CAST(churned AS DOUBLE) AS e, w, unnest(x) AS x, unnest({_COX_NAMES}) AS name, unnest({_COX_BETAS}) AS b FROM cox_w"),
    ("cox_t", """SELECT name, b, tenure, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(e) AS d, sum(e * x) AS xs,
       sum(e * w) AS e0, sum(e * w * x) AS e1, sum(e * w * x * x) AS e2 FROM cox_long GROUP BY name, b, tenure"""),
    ("cox_r", """SELECT name, b, d, xs, e0, e1, e2, sum(s0) OVER later AS r0, sum(s1) OVER later AS r1, sum(s2) OVER later AS r2
       FROM cox_t WINDOW later AS (PARTITION BY name ORDER BY tenure DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
]))
def q_cox_step(spark, sf_dir):
    """Gradient and curvature of the penalised Cox objective at literal coefficients."""
    from churnlens.operators.cox import cox_step
    return cox_step(B.scored(spark, sf_dir), COX_BETA)


@query("cox_remaining_literal", O.base(f"""
SELECT a.customer_id, a.plan, a.tenure,
       {O.fx(f"CASE WHEN exp(-max(h.h) * max(a.w)) <= {O.dbl(1e-9)} THEN {O.dbl(0.0)} ELSE sum(exp(-(u.h - h.h) * a.w)) END", 6)} AS cox_months
FROM cox_w a JOIN cox_h h ON h.t = a.tenure JOIN cox_h u ON u.t > a.tenure AND u.t <= a.tenure + {C.CLV_HORIZON_MONTHS}
GROUP BY a.customer_id, a.plan, a.tenure""", _COX_CTES + [
    ("cox_d", "SELECT tenure, sum(w) AS s0, CAST(sum(churned) AS DOUBLE) AS d FROM cox_w GROUP BY tenure"),
    ("cox_i", "SELECT tenure, d / sum(s0) OVER (ORDER BY tenure DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS inc FROM cox_d"),
    ("cox_g", f"SELECT unnest(range(0, max(tenure) + {C.CLV_HORIZON_MONTHS + 1})) AS t FROM cox_d"),
    ("cox_h", "SELECT g.t, sum(coalesce(i.inc, 0)) OVER (ORDER BY g.t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h FROM cox_g g LEFT JOIN cox_i i ON i.tenure = g.t"),
]))
def q_cox_remaining_literal(spark, sf_dir):
    """Per-account Cox remaining months for literal coefficients, with the baseline that follows from them."""
    from churnlens.operators.cox import cox_at, cox_expected_remaining
    s = B.scored(spark, sf_dir)
    return cox_expected_remaining(s, cox_at(s, COX_BETA)[0]).select("customer_id", "plan", "tenure", "cox_months")
