"""Ridge models as a pair of Spark ML stages, which pipelines fit inside folds and write to disk."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.models import _applied, solve, summaries


class _RidgeParams(Params):
    features = Param(Params._dummy(), "features", "columns of the features", TypeConverters.toListString)
    target = Param(Params._dummy(), "target", "column of the target", TypeConverters.toString)
    weight = Param(Params._dummy(), "weight", "column of the weights; none: all rows weigh the same", TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "penalty", TypeConverters.toFloat)
    bounded = Param(Params._dummy(), "bounded", "whether predictions are cut to 0 and 1", TypeConverters.toBoolean)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(weight="", alpha=200.0, bounded=True)


class Ridge(Estimator, _RidgeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Imputes by medians, clips to the range seen, standardises and fits a weighted ridge: all from sums of fit()'s rows."""

    @keyword_only
    def __init__(self, *, features=None, target=None, weight="", alpha=200.0, bounded=True):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> RidgeModel:
        names, weight = self.getOrDefault("features"), self.getOrDefault("weight")
        found = summaries(dataset, names, self.getOrDefault("target"), F.col(weight) if weight else F.lit(1.0))
        if not found:
            raise ValueError("no rows to fit")
        beta, b0 = solve(found[0], self.getOrDefault("alpha"))
        model = RidgeModel(statistics=[float(x) for f in names for x in found[0]["stats"][f]], coefficients=[float(b) for b in beta], intercept=float(b0))
        return self._copyValues(model)


class RidgeModel(Model, _RidgeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds `prediction`. Everything that was fitted is a parameter, so the model is written and read as one."""

    statistics = Param(Params._dummy(), "statistics", "median, least, greatest, mean and scale of each feature", TypeConverters.toListFloat)
    coefficients = Param(Params._dummy(), "coefficients", "of the standardised features", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "the intercept", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, statistics=None, coefficients=None, intercept=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        s, names = self.getOrDefault("statistics"), ("median", "low", "high", "mean", "scale")
        stats = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, s[i : i + 5], strict=True)]) for i in range(0, len(s), 5)])
        d = dataset.withColumns({"s": stats, "beta": F.array(*map(F.lit, self.getOrDefault("coefficients"))), "b0": F.lit(self.getOrDefault("intercept"))})
        return _applied(d, self.getOrDefault("features"), self.getOrDefault("bounded"))


def cross_fitted(stage: Estimator, df: DataFrame, fold: str) -> DataFrame:
    """df with the predictions of a stage, or a whole pipeline, fitted without each row's fold. Folds are few: each is a fit
    of its own, unlike those of models.out_of_fold, which come from one pass."""
    out = None
    for r in df.select(fold).distinct().orderBy(fold).collect():
        own = F.col(fold).eqNullSafe(F.lit(r[0]))
        part = stage.fit(df.where(~own)).transform(df.where(own))
        out = part if out is None else out.unionByName(part)
    return df.withColumn("prediction", F.lit(None).cast("double")) if out is None else out
