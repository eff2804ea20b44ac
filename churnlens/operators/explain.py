"""Per-row linear attributions and reason phrases for a fitted LR pipeline.

``contrib_j = weight_j * (x_j - mean_j)``, where the background mean is taken over the rows
passed in (in the decision engine: the ACT rows). The largest churn-raising contributions
become short phrases, equal phrases once. Weights, means and medians are model-sized numbers:
one aggregate (and one quantile job) over the rows gives the means, and the phrases are then a
plain column expression, so explaining adds no exchange to the plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StandardScalerModel, StringIndexerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens import config as C
from churnlens.functions.quantiles import quantiles
from churnlens.operators.imputer import MedianImputerModel
from churnlens.operators.model import CATEGORICAL, NUMERIC


@dataclass(frozen=True)
class Term:
    """One model feature: a numeric column, or a level of a categorical one."""

    column: str
    level: str | None
    weight: float              # per unit of the column
    mean: float = 0.0          # background
    median: float | None = None   # "high" from here on
    fill: float = 0.0          # stands in for a missing number

    def value(self) -> Column:
        if self.level is None:
            return F.coalesce(F.nanvl(F.col(self.column).cast("double"), F.lit(None)), F.lit(self.fill))
        return F.when(F.col(self.column).cast("string") == self.level, 1.0).otherwise(0.0)

    def token(self) -> Column:
        if self.level is not None:
            return F.lit(level_phrase(self.column, self.level))
        label = C.NUMERIC_LABEL.get(self.column, self.column)
        high = F.lit(False) if self.median is None else F.coalesce(F.col(self.column) >= self.median, F.lit(False))
        return F.when(high, f"high {label}").otherwise(f"low {label}")


def probability(terms: list[Term], intercept: float) -> Column:
    """The logistic model's probability as one column expression over literal weights."""
    margin = F.lit(float(intercept))
    for t in terms:
        margin = margin + F.lit(float(t.weight)) * t.value()
    return 1.0 / (1.0 + F.exp(-margin))


def level_phrase(column: str, level: str) -> str:
    """The phrase for a categorical column at a level."""
    if column == "InternetService":
        return "no internet" if level == "No" else f"{level.lower()} internet"
    if column in ("Contract", "plan"):
        return f"{level.lower()} contract"
    if column == "PaymentMethod":
        return level.lower()
    if column == "SeniorCitizen":
        return "senior citizen"
    if column in C.FLAG_LABEL:
        return ("no " if level == "No" else "") + C.FLAG_LABEL[column]
    return level or column


def phrases(terms: list[Term], top_n: int = 3) -> Column:
    """The reason of a row: up to ``top_n`` distinct phrases, largest contribution first (ties in
    the order of ``terms``)."""
    told = [(j, t) for j, t in enumerate(terms) if t.column not in C.SKIP_COLUMNS]
    if not told:
        return F.lit(C.NO_REASON)
    found = F.array(*[F.struct((F.lit(-t.weight) * (t.value() - F.lit(t.mean))).alias("less"), F.lit(j).alias("j"), t.token().alias("token"))
                      for j, t in told])
    raising = F.array_sort(F.filter(found, lambda c: c["less"] < 0))
    tokens = F.slice(F.array_distinct(F.transform(raising, lambda c: c["token"])), 1, top_n)
    return F.when(F.size(tokens) > 0, F.array_join(tokens, ", ")).otherwise(F.lit(C.NO_REASON))


def model_terms(model: PipelineModel, rows: DataFrame, numeric=NUMERIC, categorical=CATEGORICAL) -> list[Term]:
    """The terms of a fitted LR pipeline with means and medians over ``rows``."""
    stage = lambda kind: next(s for s in model.stages if isinstance(s, kind))
    coefs, fills = model.stages[-1].coefficients.toArray().tolist(), stage(MedianImputerModel).getMedians()
    spread = stage(StandardScalerModel).std.toArray().tolist()
    terms = [Term(c, None, w / s if s else 0.0, fill=f) for c, w, s, f in zip(numeric, coefs, spread, fills)]
    levels = [(c, lv) for c, labels in zip(categorical, stage(StringIndexerModel).labelsArray) for lv in labels]
    terms += [Term(c, lv, w) for (c, lv), w in zip(levels, coefs[len(terms):])]
    means = rows.agg(*[F.avg(t.value()).alias(f"m{j}") for j, t in enumerate(terms)]).first()
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in numeric]))
    medians = {r["feature"]: r["q"][0] for r in quantiles(rows.select(pairs.alias("v")).select("v.*"), [0.5]).collect()}
    return [Term(t.column, t.level, t.weight, means[f"m{j}"] or 0.0, medians.get(t.column) if t.level is None else None, t.fill)
            for j, t in enumerate(terms)]


def linear_reasons(model: PipelineModel, rows: DataFrame, top_n: int = 3,
                   numeric=NUMERIC, categorical=CATEGORICAL) -> DataFrame:
    """``(customer_id, decision_reason)`` for every row passed in."""
    return rows.select("customer_id", phrases(model_terms(model, rows, numeric, categorical), top_n).alias("decision_reason"))


def model_reasons(model: PipelineModel, top_n: int = 3, numeric=NUMERIC, categorical=CATEGORICAL) -> Callable[[DataFrame], Column]:
    """Reasons for ``decide``: the phrases with the funded rows as background."""
    return lambda funded: phrases(model_terms(model, funded, numeric, categorical), top_n)
