"""Median imputation as an own pipeline stage: the medians are the exact distributed
quantiles of :mod:`churnlens.functions.quantiles`, so no task holds a column and nothing
depends on an error bound. Saved and loaded like any other stage.

NULL and NaN are filled; a column without values is filled with 0.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.quantiles import quantiles


class MedianImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self, inputCols: list[str] | None = None, outputCols: list[str] | None = None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=inputCols, outputCols=outputCols)

    def _fit(self, df: DataFrame) -> MedianImputerModel:
        columns = self.getInputCols()
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.nanvl(F.col(c).cast("double"), F.lit(None)).alias("x"))
                                    for c in columns]))
        found = {r["feature"]: r["q"][0] for r in quantiles(df.select(pairs.alias("v")).select("v.*"), [0.5]).collect()}
        return MedianImputerModel(columns, self.getOutputCols(), [float(found.get(c, 0.0)) for c in columns])


class MedianImputerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "what fills each input column", TypeConverters.toListFloat)

    def __init__(self, inputCols: list[str] | None = None, outputCols: list[str] | None = None, medians: list[float] | None = None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=inputCols, outputCols=outputCols, medians=medians)

    def getMedians(self) -> list[float]:
        return self.getOrDefault(self.medians)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({o: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(m)) for c, o, m in zip(
            self.getInputCols(), self.getOutputCols(), self.getMedians())})
