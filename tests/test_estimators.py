"""Stages of pyspark.ml: the same as the operators, and the same again after they were saved and loaded."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel

from quefrency.operators import discriminant, pipelines
from quefrency.operators.estimators import ArrayScaler, ClassHead, ReconstructionFeatures, ReconstructionFeaturesModel


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, [float(v) for v in rng.gamma(1 + i % 3, 1.0, 6)] + [7.0]) for i in range(150)] + [(150, 0, None)]
    return spark.createDataFrame(rows, "id int, y int, x array<double>").repartition(4).persist()


def values(f, c):
    return {r.id: None if r[c] is None else np.array(r[c]).tolist() for r in f.collect()}


@pytest.mark.parametrize("config", [pipelines.Config("polynomial"), pipelines.Config("patp", 0.3, 4)])
def test_features_are_those_of_the_operators(frame, config):
    a = pipelines.standardised(frame.where("x is not null"))[0]
    want = values(pipelines.Reconstructions([config]).fit(a).features(a), "s")
    p = Pipeline(stages=[ArrayScaler(), ReconstructionFeatures(basis=config.basis, size=config.n, alpha=config.alpha)]).fit(frame)
    got = values(p.transform(frame), "features")
    assert got.pop(150) is None and got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert p.stages[1].classes == [0, 1, 2]


@pytest.mark.parametrize("kind", ["least", "distance", "qda", "rda"])
def test_a_loaded_pipeline_scores_alike(spark, frame, tmp_path, kind):
    estimator = Pipeline(stages=[ArrayScaler(), ReconstructionFeatures(basis="robust"), ClassHead(kind=kind, ridge=0.1)])
    estimator.write().overwrite().save(f"file://{tmp_path}/e")
    model = Pipeline.load(f"file://{tmp_path}/e").fit(frame)
    model.write().overwrite().save(f"file://{tmp_path}/m")
    loaded = PipelineModel.load(f"file://{tmp_path}/m")
    assert isinstance(loaded.stages[1], ReconstructionFeaturesModel) and loaded.stages[2].getOrDefault("kind") == kind
    got = values(loaded.transform(frame), "p")
    assert got == values(estimator.fit(frame).transform(frame), "p") and got.pop(150) is None and loaded.transform(frame).schema["p"].dataType.simpleString() == "int"
    y = values(frame, "y")
    assert np.mean([got[k] == y[k] for k in got]) > 0.4
    if kind == "qda":
        x = model.transform(frame).where("x is not null")
        want = discriminant.nearest(discriminant.ClassMoments.fit(x, "y", "features").qda(x, ["id"], 0.1), ["id"])
        assert got == values(want, "p")


def test_labels_may_be_strings(spark, frame):
    named = frame.where("x is not null").selectExpr("id", "concat('c', y) AS y", "x")
    model = Pipeline(stages=[ArrayScaler(), ReconstructionFeatures(), ClassHead(kind="distance")]).fit(named)
    assert set(values(model.transform(named), "p").values()) <= {"c0", "c1", "c2"}
    with pytest.raises(ValueError, match="unknown kind"):
        ClassHead(kind="other").fit(named)
    with pytest.raises(ValueError, match="no rows"):
        ArrayScaler().fit(named.limit(0))
