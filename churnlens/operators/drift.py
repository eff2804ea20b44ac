"""Data drift between a reference and current tables.

Everything follows from a *value-count state*: ``(feature, x, s, n)``, the number of rows per
feature and value (``x`` for numeric features, ``s`` for categorical ones, NULL values left
out). A state is one aggregate over one scan, states add up (:func:`merge_states`), and a report
reads states only:

* PSI numeric: decile edges of the reference (duplicates dropped, outer edges
  open), bins ``[lo, hi)``, shares floored at 1e-6, ``sum (a - e) ln(a / e)``; a
  feature with fewer than 3 distinct edges has PSI 0;
* PSI categorical: shares per category over the union of categories;
* KS: ``D = max |F_ref - F_cur|``; p-value from the asymptotic
  Kolmogorov series (1.0 for ``sqrt(n m / (n + m)) D < 0.2``, where the series
  has not converged and the true value is 1 to double precision).

The distinct values of all numeric features, and of all current tables that are compared
at once, are range-ordered together. One pass of their partitions gives the edges (a row per
feature), a second each partition's bin counts and largest distance, which merge by sum and
maximum.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens import config as C
from churnlens.functions.columns import fixed
from churnlens.functions.prefix import RangeOrdered
from churnlens.functions.quantiles import order_statistics

LEVELS = [float(v) for v in np.linspace(0, 1, 11)]
KS_TERMS = 100


def value_state(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """``(feature, x, s, n)``: one scan, one aggregate."""
    number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    values = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"), text.alias("s")) for c in numeric]
    values += [F.struct(F.lit(c).alias("feature"), number.alias("x"), F.col(c).cast("string").alias("s")) for c in categorical]
    return (df.select(F.explode(F.array(*values)).alias("v")).select("v.*").where(F.col("x").isNotNull() | F.col("s").isNotNull())
            .groupBy("feature", "x", "s").agg(F.count(F.lit(1)).alias("n")))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all rows behind the given states."""
    return reduce(DataFrame.unionByName, states).groupBy("feature", "x", "s").agg(F.sum("n").alias("n"))


class ReferenceProfile:
    """A reference's value-count state, counted once and kept for many comparisons."""

    def __init__(self, ref: DataFrame, numeric: list[str], categorical: list[str], persist: bool = False):
        self.numeric, self.categorical = list(numeric), list(categorical)
        self.state = value_state(ref, self.numeric, self.categorical)
        if persist:
            self.state = self.state.persist()


def _compare(profile: ReferenceProfile, current: dict[str, DataFrame]) -> DataFrame:
    """``(label, feature, x, s, kr, kc)``: reference and current counts per value, for every
    current state, checkpointed: each state is read once."""
    none = F.lit(0).cast("long")
    labels = F.explode(F.array(*map(F.lit, current))).alias("label")
    sides = [profile.state.select(labels, "feature", "x", "s", F.col("n").alias("kr"), none.alias("kc"))]
    sides += [state.select(F.lit(label).alias("label"), "feature", "x", "s", none.alias("kr"), F.col("n").alias("kc"))
              for label, state in current.items()]
    return (reduce(DataFrame.unionByName, sides).groupBy("label", "feature", "x", "s")
            .agg(F.sum("kr").alias("kr"), F.sum("kc").alias("kc")).checkpoint())


def _numeric(counts: DataFrame) -> DataFrame:
    """``(label, feature, n_ref, n_cur, ks_d, ks_pvalue, psi)`` of the numeric features."""
    by = ["label", "feature"]
    ordered = RangeOrdered(counts.where(F.col("x").isNotNull()).select(*by, "x", "kr", "kc"), [F.col("x").asc()], partition_by=by)
    sums = {"cr": F.col("kr"), "cc": F.col("kc")}
    boil, names = order_statistics(LEVELS, "cr")
    found = (ordered.reduce(sums, boil, "total long, " + ", ".join(f"{n} double" for n in names))
             .groupBy(*by).agg(F.max("total").alias("total"), *[F.max(n).alias(n) for n in names]).collect())
    inner: dict[tuple, np.ndarray] = {}                       # a row per label and feature
    for r in found:
        edges = []
        for k, p in enumerate(LEVELS):
            low, high, at = r[names[2 * k]], r[names[2 * k + 1]], (r["total"] - 1) * p
            if low is not None:
                edges.append(low if low == high else (np.ceil(at) - at) * low + (at - np.floor(at)) * high)
        inner[r["label"], r["feature"]] = np.unique(edges)[1:-1]

    def bins(rows, places, run, totals):
        nr, nc = int(totals["cr"]), int(totals["cc"])
        apart = float(np.abs(run["cr"] / max(nr, 1) - run["cc"] / max(nc, 1)).max())
        edges = inner[rows["label"].iloc[0], rows["feature"].iloc[0]]
        at = np.searchsorted(edges, rows["x"].to_numpy(), side="right")
        kr, kc = rows["kr"].to_numpy(), rows["kc"].to_numpy()
        return [(int(b), len(edges), nr, nc, apart, int(kr[at == b].sum()), int(kc[at == b].sum())) for b in range(len(edges) + 1)]

    per_bin = (ordered.reduce(sums, bins, "b int, n_inner int, n_ref long, n_cur long, apart double, kr long, kc long")
               .groupBy(*by, "b").agg(F.max("n_inner").alias("n_inner"), F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"),
                                      F.max("apart").alias("apart"), F.sum("kr").alias("kr"), F.sum("kc").alias("kc")))
    share = lambda part, whole: F.greatest(F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0), F.lit(C.SHARE_FLOOR))
    e, a = share("kr", "n_ref"), share("kc", "n_cur")
    d = per_bin.groupBy(*by).agg(F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"), F.max("apart").alias("ks_d"),
                                 F.when(F.max("n_inner") < 1, 0.0).otherwise(F.sum((a - e) * F.log(a / e))).alias("psi"))
    z = F.sqrt(F.col("n_ref").cast("double") * F.col("n_cur") / (F.col("n_ref") + F.col("n_cur"))) * F.col("ks_d")
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * k * k * F.col("z") * F.col("z")))
    one_side = (F.col("n_ref") == 0) | (F.col("n_cur") == 0)  # no values at all on one side: drift
    p = F.when(one_side, F.lit(0.0)).when(F.col("z") < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series)))
    return d.withColumn("z", z).select(*by, "n_ref", "n_cur", "ks_d", p.alias("ks_pvalue"), "psi")


def _categorical(counts: DataFrame) -> DataFrame:
    """``(label, feature, psi)`` of the categorical features."""
    rows = counts.where(F.col("s").isNotNull())
    totals = rows.groupBy("label", "feature").agg(F.sum("kr").alias("tr"), F.sum("kc").alias("tc"))   # a row per feature
    share = lambda part, whole: F.greatest(F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0)), F.lit(C.SHARE_FLOOR))
    e, a = share("kr", "tr"), share("kc", "tc")
    return rows.join(F.broadcast(totals), ["label", "feature"]).groupBy("label", "feature").agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def psi_numeric_vs(profile: ReferenceProfile, cur: DataFrame) -> DataFrame:
    """:func:`psi_numeric` against a stored reference."""
    return _numeric(_compare(profile, {"": value_state(cur, profile.numeric, [])})).select("feature", "psi")


def ks_vs(profile: ReferenceProfile, cur: DataFrame) -> DataFrame:
    """:func:`ks_statistic` against a stored reference."""
    return _numeric(_compare(profile, {"": value_state(cur, profile.numeric, [])})).select(
        "feature", "n_ref", "n_cur", "ks_d", "ks_pvalue")


def psi_numeric(ref: DataFrame, cur: DataFrame, columns: list[str]) -> DataFrame:
    """``(feature, psi)`` for numeric columns (psi unrounded)."""
    return psi_numeric_vs(ReferenceProfile(ref, columns, []), cur)


def psi_categorical(ref: DataFrame, cur: DataFrame, columns: list[str]) -> DataFrame:
    """``(feature, psi)`` for categorical columns over the union of categories."""
    return _categorical(_compare(ReferenceProfile(ref, [], columns), {"": value_state(cur, [], columns)})).select("feature", "psi")


def ks_statistic(ref: DataFrame, cur: DataFrame, columns: list[str]) -> DataFrame:
    """``(feature, n_ref, n_cur, ks_d, ks_pvalue)`` (unrounded)."""
    return ks_vs(ReferenceProfile(ref, columns, []), cur)


def drift_report(ref: DataFrame, cur: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """One row per feature, worst first: PSI (3 dp), KS p-value (4 dp, numeric only),
    drift flag on unrounded values (PSI > 0.25, or KS p < 0.01 for numeric)."""
    return drift_report_vs(ReferenceProfile(ref, numeric, categorical), cur)


def drift_report_vs(profile: ReferenceProfile, cur: DataFrame) -> DataFrame:
    """The drift report of ``cur`` against a stored reference profile."""
    return drift_reports(profile, {"": value_state(cur, profile.numeric, profile.categorical)}).drop("label").orderBy(
        F.col("psi").desc(), "feature")


def drift_reports(profile: ReferenceProfile, current: dict[str, DataFrame]) -> DataFrame:
    """The reports of several current states ``{label: state}`` in the same jobs, with their ``label``."""
    counts, parts = _compare(profile, current), []
    if profile.numeric:
        parts.append(_numeric(counts).select(
            "label", "feature", F.lit("numeric").alias("type"), fixed("psi", 3).alias("psi"),
            fixed("ks_pvalue", 4).alias("ks_pvalue"),
            ((F.col("psi") > C.PSI_THRESHOLD) | (F.col("ks_pvalue") < C.KS_PVALUE_THRESHOLD)).alias("drift")))
    if profile.categorical:
        parts.append(_categorical(counts).select(
            "label", "feature", F.lit("categorical").alias("type"), fixed("psi", 3).alias("psi"),
            F.lit(None).cast("double").alias("ks_pvalue"), (F.col("psi") > C.PSI_THRESHOLD).alias("drift")))
    return reduce(DataFrame.unionByName, parts)
