"""Scaling, reconstruction features and class heads as pyspark.ml stages, to be put in a Pipeline, saved and loaded.

What a stage has learned is a parameter of its model (JSON, a few numbers a class and feature), so that Spark's own writers
keep it. Fits are the grouped passes of the operators; transforms are Arrow-batched columns.
"""

from __future__ import annotations

import json
from functools import partial

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quefrency.functions import basis, columns
from quefrency.operators import moments, pipelines
from quefrency.operators.discriminant import ClassMoments

_DUMMY = Params._dummy()


class _Learned(Model, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A model whose state is one parameter."""

    state = Param(_DUMMY, "state", "what was learned, as JSON", typeConverter=TypeConverters.toString)

    def learned(self) -> dict:
        return json.loads(self.getOrDefault(self.state))


def _model(cls, estimator: Params, state: dict):
    out = estimator._copyValues(cls())
    return out._set(state=json.dumps(state))


# --- scaling ---------------------------------------------------------------------------------------------------------


def _scaled(m: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    return (m - mean) / std


class ArrayScalerModel(_Learned):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        s = self.learned()
        f = columns.rows(partial(_scaled, mean=np.array(s["mean"]), std=np.array(s["std"])))
        return dataset.withColumn(self.getOutputCol(), f(F.col(self.getInputCol()).cast("array<double>")))


class ArrayScaler(Estimator, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Array columns less the rows' mean, by their population deviation; constant elements by 1. Null arrays take no part and stay null."""

    @keyword_only
    def __init__(self, *, inputCol: str = "x", outputCol: str = "scaled"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(inputCol="x", outputCol="scaled")

    def _fit(self, dataset: DataFrame) -> ArrayScalerModel:
        own = dataset.select(F.lit(0).alias("k"), F.col(self.getInputCol()).cast("array<double>").alias("s")).where("s is not null")
        parts = moments.grouped(own, {"k": "int"}, lambda b: [((0,), moments.stacked(b["s"]))] if len(b) else [])
        if not parts:
            raise ValueError("no rows to learn from")
        return _model(ArrayScalerModel, self, {"mean": parts[(0,)][1].tolist(), "std": moments.deviation(*parts[(0,)]).tolist()})


# --- reconstruction features -----------------------------------------------------------------------------------------


class _BasisParams(Params):
    basis = Param(_DUMMY, "basis", "name of the basis", typeConverter=TypeConverters.toString)
    size = Param(_DUMMY, "size", "number of basis functions", typeConverter=TypeConverters.toInt)
    alpha = Param(_DUMMY, "alpha", "parameter of the PATP basis", typeConverter=TypeConverters.toFloat)
    ridge = Param(_DUMMY, "ridge", "added to the covariance's diagonal", typeConverter=TypeConverters.toFloat)

    def config(self) -> pipelines.Config:
        return pipelines.Config(self.getOrDefault(self.basis), self.getOrDefault(self.alpha) if self.isDefined(self.alpha) else None, self.getOrDefault(self.size))


def _errors(m: np.ndarray, g: pipelines.Config, models: list) -> np.ndarray:
    phi = basis.arrays(g.basis, m, g.n, g.alpha)
    return np.column_stack([np.log(((m - k0 - phi @ np.array(w)) ** 2).mean(axis=1) + pipelines.EPS) for k0, w in models])


class ReconstructionFeaturesModel(_Learned, _BasisParams, HasLabelCol):
    """The features are in the order of `classes`."""

    @property
    def classes(self) -> list:
        return self.learned()["classes"]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        f = columns.rows(partial(_errors, g=self.config(), models=self.learned()["models"]))
        return dataset.withColumn(self.getOutputCol(), f(F.col(self.getInputCol()).cast("array<double>")))


class ReconstructionFeatures(Estimator, _BasisParams, HasInputCol, HasOutputCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """For each class the log mean squared error of a sample's reconstruction from its basis functions."""

    @keyword_only
    def __init__(self, *, inputCol: str = "scaled", outputCol: str = "features", labelCol: str = "y", basis: str = "fractional", size: int = 3, alpha: float | None = None, ridge: float = pipelines.RIDGE):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})
        self._setDefault(inputCol="scaled", outputCol="features", labelCol="y", basis="fractional", size=3, ridge=pipelines.RIDGE)

    def _fit(self, dataset: DataFrame) -> ReconstructionFeaturesModel:
        g = self.config()
        r = pipelines.Reconstructions([g], self.getOrDefault(self.ridge)).fit(dataset.where(F.col(self.getInputCol()).isNotNull()), self.getLabelCol(), self.getInputCol())
        own = r.models.get(g.name, {})
        return _model(ReconstructionFeaturesModel, self, {"classes": [_plain(c) for c in own], "models": [(float(k0), w.tolist()) for k0, w, _ in own.values()]})


def _plain(label):
    return label.item() if isinstance(label, np.generic) else label


# --- heads -----------------------------------------------------------------------------------------------------------


class _HeadParams(Params):
    kind = Param(_DUMMY, "kind", "least (feature), distance, qda or rda", typeConverter=TypeConverters.toString)
    ridge = Param(_DUMMY, "ridge", "of distance; reg of qda", typeConverter=TypeConverters.toFloat)
    lam = Param(_DUMMY, "lam", "share of the pooled covariance", typeConverter=TypeConverters.toFloat)
    gam = Param(_DUMMY, "gam", "share of the identity", typeConverter=TypeConverters.toFloat)


def _least(m: np.ndarray) -> np.ndarray:
    return -m


class ClassHeadModel(_Learned, _HeadParams, HasLabelCol, HasPredictionCol):
    def _kernel(self, s: dict):
        kind = self.getOrDefault(self.kind)
        if kind == "least":
            return _least
        m = ClassMoments("s", np.array(s["mean"]), np.array(s["std"]), {i: (n, np.array(mu), np.array(cov)) for i, (n, mu, cov) in enumerate(s["moments"])})
        if kind == "distance":
            f = m.kernel(m.ridge_forms(self.getOrDefault(self.ridge)))
            return lambda x: -f(x)
        return m.kernel(m.qda_forms(self.getOrDefault(self.ridge)) if kind == "qda" else m.rda_forms(self.getOrDefault(self.lam), self.getOrDefault(self.gam)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        s = self.learned()
        kernel, classes = self._kernel(s), F.array(*(F.lit(c) for c in s["classes"]))
        best = columns.rows(lambda m: kernel(m).argmax(axis=1).astype(float)[:, None])
        place = best(F.col(self.getInputCol()).cast("array<double>"))
        return dataset.withColumn(self.getPredictionCol(), F.get(classes, F.get(place, F.lit(0)).cast("int")).cast(s["type"]))


class ClassHead(Estimator, _HeadParams, HasInputCol, HasOutputCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """The class whose feature is the least (of features in the order of the classes), that is nearest by regularised distance,
    or the likeliest by a quadratic or regularised discriminant; ties go to the first class."""

    @keyword_only
    def __init__(self, *, inputCol: str = "features", labelCol: str = "y", predictionCol: str = "p", kind: str = "least", ridge: float = 0.05, lam: float = 0.5, gam: float = 0.1):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(inputCol="features", labelCol="y", predictionCol="p", kind="least", ridge=0.05, lam=0.5, gam=0.1)

    def _fit(self, dataset: DataFrame) -> ClassHeadModel:
        if self.getOrDefault(self.kind) not in ("least", "distance", "qda", "rda"):
            raise ValueError(f"unknown kind {self.getOrDefault(self.kind)!r}")
        y, kind = self.getLabelCol(), dataset.schema[self.getLabelCol()].dataType.simpleString()
        if self.getOrDefault(self.kind) == "least":
            labels = sorted(r[0] for r in dataset.select(y).where(F.col(y).isNotNull()).distinct().collect())
            return _model(ClassHeadModel, self, {"classes": labels, "type": kind})
        m = ClassMoments.fit(dataset.where(F.col(y).isNotNull() & F.col(self.getInputCol()).isNotNull()), y, self.getInputCol())
        own = [(int(n), mu.tolist(), cov.tolist()) for n, mu, cov in m.classes.values()]
        return _model(ClassHeadModel, self, {"classes": [_plain(c) for c in m.classes], "type": kind, "mean": m.mean.tolist(), "std": m.std.tolist(), "moments": own})
