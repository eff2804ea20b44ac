"""Cox proportional-hazards model with Efron ties, fitted by Newton's method.

Covariates: numeric columns and one-hot categorical columns with the first
(alphabetical) level dropped, all of them standardised (mean 0, sample deviation 1), so
that the penalty weighs them alike. Objective: mean partial log-likelihood
minus ``penalizer / 2 * ||beta||^2`` (our documented definition of the penalty).

Each Newton step is one distributed pass: a ``mapInPandas`` task computes, per
tenure value, partial sums of ``r = exp(beta'x)``, ``r x``, ``r x x'`` over all
rows and over event rows (numpy inside the task), Spark sums them per tenure with
``Summarizer`` and the driver receives at most (#tenure values) rows of
O(p^2) numbers. Risk sets are suffix sums over tenure on the driver, and the sums
over tied events have a closed form (``tie_sums``).

Per-account expected remaining months over a horizon H:
``sum_{u=t0+1..t0+H} exp(-(H0(u) - H0(t0)) * r)`` (0 when S(t0) <= 1e-9), with the
baseline cumulative hazard H0 (Breslow: deaths by risk sum) as a literal array of max_t + H + 1 values.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens import config as C
from churnlens.functions.columns import fixed

log = logging.getLogger(__name__)

NUMERIC = ["MonthlyCharges", "TotalCharges"]
CATEGORICAL = ["plan", "segment", "region"]


class CoxModel:
    def __init__(self, names, beta, means, stds, levels, h0, max_t, converged, iterations):
        self.names, self.beta, self.means, self.stds = names, beta, means, stds
        self.levels, self.h0, self.max_t = levels, h0, max_t
        self.converged, self.iterations = converged, iterations

    def design(self, df: DataFrame, numeric, categorical) -> list:
        return [(x - F.lit(m)) / F.lit(d) for x, m, d in zip(_raw_design(numeric, categorical, self.levels), self.means, self.stds)]

    def risk(self, df: DataFrame, numeric, categorical):
        eta = F.lit(0.0)
        for w, x in zip(self.beta, self.design(df, numeric, categorical)):
            eta = eta + F.lit(float(w)) * x
        return F.exp(eta)


def _raw_design(numeric, categorical, levels) -> list:
    """The covariates before standardisation, in the order of the model's names."""
    return [F.col(c).cast("double") for c in numeric] + [
        F.when(F.col(c) == lv, 1.0).otherwise(0.0) for c in categorical for lv in levels[c][1:]]


def _upper(p):
    return [(i, j) for i in range(p) for j in range(i, p)]


def _stats_pass(x_df: DataFrame, beta: np.ndarray, p: int, duration: str, event: str):
    """Per-tenure sums: n, S0, S1, S2(upper), d, X, E0, E1, E2(upper)."""
    up = _upper(p)
    width = 1 + 1 + p + len(up) + 1 + p + 1 + p + len(up)
    xcols = [f"x{i}" for i in range(p)]
    bvec = beta.copy()
    iu = np.array(up).T if up else (np.array([], int), np.array([], int))

    def part(batches):
        total = None                                # one row per tenure and task
        for pdf in batches:
            if pdf.empty:
                continue
            X = pdf[xcols].to_numpy(dtype=float)   # columnar Arrow batch, no per-row objects
            e = pdf[event].to_numpy(dtype=float)
            r = np.exp(X @ bvec)
            xx = (X[:, iu[0]] * X[:, iu[1]])
            stats = np.column_stack([
                np.ones(len(pdf)), r, r[:, None] * X, r[:, None] * xx,
                e, e[:, None] * X, e * r, (e * r)[:, None] * X, (e * r)[:, None] * xx])
            g = pd.DataFrame(stats).groupby(pdf[duration].to_numpy()).sum()
            total = g if total is None else total.add(g, fill_value=0.0)
        if total is not None:
            yield pd.DataFrame({"t": total.index.astype("int64"), "s": list(total.to_numpy())})

    schema = T.StructType([T.StructField("t", T.LongType()), T.StructField("s", T.ArrayType(T.DoubleType()))])
    partial = x_df.mapInPandas(part, schema)
    summed = (partial.groupBy("t").agg(Summarizer.sum(array_to_vector("s")).alias("v"))
              .select("t", vector_to_array("v").alias("s")).collect())
    summed.sort(key=lambda r: r["t"])
    ts = np.array([r["t"] for r in summed])
    S = np.array([r["s"] for r in summed]).reshape(len(summed), width)
    return ts, S, up


def _unpack(S, p, up):
    k = len(up)
    o = 0
    n = S[:, o]; o += 1
    s0 = S[:, o]; o += 1
    s1 = S[:, o:o + p]; o += p
    s2 = S[:, o:o + k]; o += k
    d = S[:, o]; o += 1
    xsum = S[:, o:o + p]; o += p
    e0 = S[:, o]; o += 1
    e1 = S[:, o:o + p]; o += p
    e2 = S[:, o:o + k]
    return n, s0, s1, s2, d, xsum, e0, e1, e2


def _full(vec_upper, p, up):
    m = np.zeros((p, p))
    for v, (i, j) in zip(vec_upper, up):
        m[i, j] = m[j, i] = v
    return m


def _digamma(x: float) -> float:
    """Derivative of log-gamma, x > 0: recurrence up to 12, then the asymptotic series."""
    low = 0.0
    while x < 12:
        low -= 1 / x
        x += 1
    y = 1 / (x * x)
    return low + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def _trigamma(x: float) -> float:
    low = 0.0
    while x < 12:
        low += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return low + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66))))


def tie_sums(r: float, e: float, d: int) -> tuple[float, float, float]:
    """Sums over l = 0..d-1 of log u, 1/u and 1/u^2 with u = r - l e / d, in closed
    form: the work does not grow with the number of tied events."""
    x, scale = r * d / e, d / e
    low = max(x - d, 0.0) + 1
    return (d * math.log(e / d) + math.lgamma(x + 1) - math.lgamma(low),
            scale * (_digamma(x + 1) - _digamma(low)), scale * scale * (_trigamma(low) - _trigamma(x + 1)))


def _efron(beta, ts, S, p, up, n_rows, penalizer):
    n, s0, s1, s2, d, xsum, e0, e1, e2 = _unpack(S, p, up)
    # risk sets: suffix sums over tenure (duration >= t)
    r0 = np.cumsum(s0[::-1])[::-1]
    r1 = np.cumsum(s1[::-1], axis=0)[::-1]
    r2 = np.cumsum(s2[::-1], axis=0)[::-1]
    ll, grad, hess = 0.0, np.zeros(p), np.zeros((p, p))
    for i in range(len(ts)):
        di = int(round(d[i]))
        if di == 0:
            continue
        r, e = r0[i], e0[i]
        logs, a1, a2 = tie_sums(r, e, di)
        # sums of f/u, f/u^2, f^2/u^2 with f = l/d = (r - u)/e
        f1, f2, ff2 = (r * a1 - di) / e, (r * a2 - a1) / e, (r * r * a2 - 2 * r * a1 + di) / (e * e)
        ll += float(xsum[i] @ beta) - logs
        grad += xsum[i] - (r1[i] * a1 - e1[i] * f1)
        mixed = np.outer(r1[i], e1[i])
        hess -= (_full(r2[i] * a1 - e2[i] * f1, p, up) - np.outer(r1[i], r1[i]) * a2
                 + (mixed + mixed.T) * f2 - np.outer(e1[i], e1[i]) * ff2)
    f = ll / n_rows - 0.5 * penalizer * float(beta @ beta)
    g = grad / n_rows - penalizer * beta
    h = hess / n_rows - penalizer * np.eye(p)
    return f, g, h


def _baseline(ts, S, p, up, horizon_end):
    n, s0, s1, s2, d, *_ = _unpack(S, p, up)
    inc = np.divide(d, np.cumsum(s0[::-1])[::-1], out=np.zeros(len(ts)), where=d > 0)
    h = np.zeros(horizon_end + 1)
    cum = 0.0
    pos = {int(t): k for k, t in enumerate(ts)}
    for t in range(horizon_end + 1):
        if t in pos:
            cum += inc[pos[t]]
        h[t] = cum
    return h


def _prepare(df: DataFrame, numeric, categorical, duration: str, event: str):
    """(model without coefficients, standardised covariates with duration and event, rows)."""
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.max(duration).alias("max_t"),
                 *[F.sort_array(F.collect_set(c)).alias(f"l_{c}") for c in categorical]).first()
    levels = {c: list(agg[f"l_{c}"]) for c in categorical}   # few levels per column
    names = list(numeric) + [f"{c}_{lv}" for c in categorical for lv in levels[c][1:]]
    raw = _raw_design(numeric, categorical, levels)
    scale = df.agg(*[F.avg(x) for x in raw], *[F.stddev_samp(x) for x in raw]).first()
    p = len(names)
    model = CoxModel(names, np.zeros(p), [float(m) for m in scale[:p]], [float(v or 1.0) for v in scale[p:]], levels,
                     None, int(agg["max_t"]), False, 0)
    x_df = df.select(F.col(duration).cast("long").alias(duration), F.col(event).cast("double").alias(event),
                     *[c.alias(f"x{i}") for i, c in enumerate(model.design(df, numeric, categorical))])
    return model, x_df, int(agg["n"])


def cox_at(df: DataFrame, beta: dict, numeric=NUMERIC, categorical=CATEGORICAL, duration: str = "tenure", event: str = "churned",
           penalizer: float = C.COX_PENALIZER, horizon: int = C.CLV_HORIZON_MONTHS):
    """(model, step) for given coefficients (by name, of standardised covariates; 0 where none is given), in one
    pass over the rows: the model with its baseline, and per covariate the gradient and the diagonal curvature of
    the fit's objective there."""
    model, x_df, n_rows = _prepare(df, numeric, categorical, duration, event)
    p = len(model.names)
    model.beta = np.array([float(beta.get(name, 0.0)) for name in model.names])
    ts, S, up = _stats_pass(x_df, model.beta, p, duration, event)
    _, gradient, curvature = _efron(model.beta, ts, S, p, up, n_rows, penalizer)
    model.h0 = _baseline(ts, S, p, up, model.max_t + horizon)
    return model, list(zip(model.names, gradient.tolist(), np.diag(curvature).tolist()))


def cox_step(df: DataFrame, beta: dict, **settings) -> DataFrame:
    """Gradient and diagonal curvature of the objective at ``beta``, one row per covariate."""
    rows = cox_at(df, beta, **settings)[1]
    return df.sparkSession.createDataFrame(rows, "covariate string, gradient double, curvature double").select(
        "covariate", fixed("gradient", 6).alias("gradient"), fixed("curvature", 6).alias("curvature"))


def fit_cox(df: DataFrame, numeric=NUMERIC, categorical=CATEGORICAL, duration: str = "tenure",
            event: str = "churned", penalizer: float = C.COX_PENALIZER, horizon: int = C.CLV_HORIZON_MONTHS,
            max_iter: int = 50, tol: float = 1e-7) -> CoxModel:
    """Fit by Newton with step halving; returns coefficients and baseline hazard."""
    model, x_df, n_rows = _prepare(df, numeric, categorical, duration, event)
    x_df = x_df.persist()
    p = len(model.names)
    beta = np.zeros(p)
    ts, S, up = _stats_pass(x_df, beta, p, duration, event)
    f, g, h = _efron(beta, ts, S, p, up, n_rows, penalizer)
    it, converged = 0, False
    for it in range(1, max_iter + 1):
        step = np.linalg.solve(h, g)
        t_len = 1.0
        while True:
            cand = beta - t_len * step
            ts2, S2, _ = _stats_pass(x_df, cand, p, duration, event)
            f2, g2, h2 = _efron(cand, ts2, S2, p, up, n_rows, penalizer)
            if f2 >= f - 1e-12 or t_len < 1e-4:
                break
            t_len /= 2
        beta, ts, S, f, g, h = cand, ts2, S2, f2, g2, h2
        if np.max(np.abs(t_len * step)) < tol:
            converged = True
            break
    x_df.unpersist()
    model.beta, model.iterations, model.converged = beta, it, converged
    model.h0 = _baseline(ts, S, p, up, model.max_t + horizon)
    return model


def cox_expected_remaining(df: DataFrame, model: CoxModel, numeric=NUMERIC, categorical=CATEGORICAL,
                           duration: str = "tenure", horizon: int = C.CLV_HORIZON_MONTHS) -> DataFrame:
    """Adds ``cox_months`` = restricted mean residual life over ``horizon``."""
    h0 = F.array(*[F.lit(float(v)) for v in model.h0])        # max_t + horizon + 1 values
    r = model.risk(df, numeric, categorical)
    t0 = F.least(F.col(duration), F.lit(model.max_t))
    base = F.element_at(h0, t0 + 1)
    window = F.slice(h0, t0 + 2, F.lit(horizon))
    total = F.aggregate(window, F.lit(0.0), lambda acc, h: acc + F.exp(-(h - F.col("__h0t")) * F.col("__r")))
    s_t0 = F.exp(-F.col("__h0t") * F.col("__r"))
    return (df.withColumn("__r", r).withColumn("__h0t", base)
            .withColumn("cox_months", fixed(F.when(s_t0 <= 1e-9, F.lit(0.0)).otherwise(total), 6))
            .drop("__r", "__h0t"))


def cox_expected_remaining_checked(df: DataFrame, horizon: int = C.CLV_HORIZON_MONTHS, numeric=NUMERIC, categorical=CATEGORICAL):
    """Method choice: Cox when the table has >= MIN_COX_ROWS rows, the fit converges
    and every estimate is present and positive; ``None`` otherwise (the caller falls back to KM)."""
    n = df.count()
    if n < C.MIN_COX_ROWS:
        return None
    try:
        model = fit_cox(df, numeric, categorical, horizon=horizon)
    except np.linalg.LinAlgError as e:
        log.warning("Cox fit failed (%s); using Kaplan-Meier", e)
        return None
    if not model.converged:
        log.warning("Cox fit did not converge in %d steps; using Kaplan-Meier", model.iterations)
        return None
    out = cox_expected_remaining(df, model, numeric, categorical, horizon=horizon).withColumnRenamed("cox_months", "expected_months")
    bad = out.where(F.col("expected_months").isNull() | (F.col("expected_months") <= 0)).limit(1).count()
    return None if bad else out


def cox_vs_km(df: DataFrame, model: CoxModel, group: str = "plan") -> DataFrame:
    """Correlation of Cox and KM expected months, and the mean within-plan sd of
    the Cox estimate (1 row)."""
    from churnlens.operators.survival import expected_remaining_by_group
    km = df if "expected_months" in df.columns else expected_remaining_by_group(df, group)
    both = cox_expected_remaining(km, model)
    spread = both.groupBy(group).agg(F.stddev_samp("cox_months").alias("sd")).agg(F.avg("sd")).scalar()
    return both.agg(fixed(F.corr("cox_months", "expected_months"), 6).alias("corr_cox_km"),
                    fixed(F.avg("cox_months"), 4).alias("mean_cox_months"),
                    fixed(F.avg("expected_months"), 4).alias("mean_km_months")).withColumn(
        "within_plan_sd", fixed(spread, 4))
