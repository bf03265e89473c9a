"""Transformers and engines in pyspark.ml pipelines."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel

from flowsift.operators import transformers
from flowsift.plans.stages import AnomalyEngine, FeatureStep


@pytest.fixture(scope="module")
def rows(spark):
    x = np.random.default_rng(7).normal(size=(120, 3)) * [1, 5, 2]
    x = np.c_[x, np.arange(120) % 3]
    return spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (500, None)], "flow_id long, features array<double>").cache()


NAMES = ["fwd_max_pkt_length", "fwd_iat_max", "bwd_iat_max", "protocol"]


@pytest.mark.parametrize(("engine", "options"), [("one_class_svm", {"nu": 0.1, "gamma": 0.2}), ("isolation_forest", {"trees": 5, "max_samples": 0.5}), ("autoencoder", {"epochs": 3}), ("local_outlier_factor", {"k": 5})])
def test_pipelines_are_fitted_saved_and_loaded(rows, tmp_path, engine, options):
    steps = [FeatureStep(transformer="onehot_encoder", outputCol="wide", names=NAMES), FeatureStep(transformer="standard_scaler", inputCol="wide", outputCol="scaled"), FeatureStep(transformer="pca_reducer_2", inputCol="scaled", outputCol="x")]
    last = AnomalyEngine(engine=engine, idCol="flow_id", inputCol="x", options=json.dumps(options), share=0.9)
    if engine == "autoencoder":  # stages that are not fitted yet are saved too
        Pipeline(stages=[*steps, last]).save(f"{tmp_path}/unfitted")
        steps, last = (lambda s: (s[:-1], s[-1]))(Pipeline.load(f"{tmp_path}/unfitted").getStages())
    fitted = Pipeline(stages=[*steps, last]).fit(rows)
    scored = {r["flow_id"]: (r["score"], r["label"]) for r in fitted.transform(rows).collect()}
    assert len(scored) == 121 and scored[500] == (None, 0)
    assert len(fitted.stages[0].output_names()) == 6 and fitted.transform(rows).select("x").first()[0].__len__() == 2
    if engine == "autoencoder":
        assert sum(v[1] for v in scored.values()) == 12
    fitted.save(f"{tmp_path}/model")
    loaded = PipelineModel.load(f"{tmp_path}/model")
    assert {r["flow_id"]: (r["score"], r["label"]) for r in loaded.transform(rows).collect()} == scored
    plain = transformers.standard_scaler(fitted.stages[0].transform(rows).where("features IS NOT NULL"), "wide")
    assert transformers.step_state(plain) == transformers.step_state(fitted.stages[1].step)
