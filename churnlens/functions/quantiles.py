"""Exact quantiles with linear interpolation (as SQL ``quantile_cont``) at any size.

Values are counted, the distinct values are range-ordered, and every partition gives the
order statistics around the levels' positions that lie in it. No task holds a
group's values. NULL values do not count; a feature without values gives no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions.prefix import RangeOrdered


def order_statistics(levels: list[float], upto: str):
    """A function for ``RangeOrdered.reduce`` over distinct values ``x`` with their running count
    ``upto``: total and the neighbours below and above each level's position, as far as a slice
    has them; and the neighbours' names."""
    def boil(rows, places, run, totals):
        total = int(totals[upto])
        ends = run[upto]
        begins = np.r_[ends[0] - rows["__in_" + upto].to_numpy()[0], ends[:-1]]
        out = []
        for p in levels:
            for place in (np.floor((total - 1) * p), np.ceil((total - 1) * p)):
                k = int(np.searchsorted(ends, place, side="right"))
                out.append(float(rows["x"].iloc[k]) if k < len(ends) and begins[k] <= place else None)
        return [(total, *out)]
    return boil, [f"{side}{k}" for k in range(len(levels)) for side in ("low", "high")]


def quantiles(values: DataFrame, levels: list[float]) -> DataFrame:
    """``(feature, q)`` of ``values(feature, x)``: one value per level, in order."""
    counts = values.where(F.col("x").isNotNull()).groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"))
    boil, names = order_statistics(levels, "upto")
    at = [(F.col("total") - 1) * F.lit(float(p)) for p in levels]
    found = (RangeOrdered(counts, [F.col("x")], ["feature"])
             .reduce({"upto": F.col("n")}, boil, "total long, " + ", ".join(f"{n} double" for n in names))
             .groupBy("feature").agg(F.max("total").alias("total"), *[F.max(n).alias(n) for n in names]))

    def between(k: int, a: Column) -> Column:
        low, high = F.col(f"low{k}"), F.col(f"high{k}")
        return F.when(low == high, low).otherwise((F.ceil(a) - a) * low + (a - F.floor(a)) * high)

    return found.select("feature", F.array(*[between(k, a) for k, a in enumerate(at)]).alias("q"))


def column_quantiles(df: DataFrame, columns: list[str], levels: list[float]) -> Column:
    """A scalar struct with one array per column: its quantiles over all rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns]))
    found = quantiles(df.select(pairs.alias("v")).select("v.feature", "v.x"), levels)
    return found.agg(*[F.max(F.when(F.col("feature") == c, F.col("q"))).alias(c) for c in columns]).select(
        F.struct(*columns)).scalar()
