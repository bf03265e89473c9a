"""Transformers and engines as pyspark.ml stages: fitted in a Pipeline, saved and loaded with it.

FeatureStep is any of lifecycle.TRANSFORMERS over a column of feature arrays, AnomalyEngine any of lifecycle.ENGINES, fitted to all rows. Fitted steps are parameters in JSON; fitted
engines are saved as a table beside their parameters. Rows with null features score null and are benign.
"""

from __future__ import annotations

import json
import uuid

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.functions.scratch import shared_folder
from flowsift.operators import engines, neighbours, transformers
from flowsift.plans import lifecycle


class _Step(HasInputCol, HasOutputCol):
    transformer = Param(Params._dummy(), "transformer", "a name of lifecycle.TRANSFORMERS", TypeConverters.toString)
    names = Param(Params._dummy(), "names", "names of the features, which some transformers need", TypeConverters.toListString)


class FeatureStep(Estimator, _Step, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, transformer: str | None = None, inputCol: str | None = None, outputCol: str | None = None, names: list[str] | None = None) -> None:
        super().__init__()
        self._setDefault(inputCol="features", outputCol="features", names=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> FeatureStepModel:
        rows = dataset.where(F.col(self.getInputCol()).isNotNull())
        step = lifecycle.TRANSFORMERS[self.getOrDefault("transformer")](rows, self.getInputCol(), self.getOrDefault("names"))
        return self._copyValues(FeatureStepModel()._set(state=json.dumps(transformers.step_state(step))))


class FeatureStepModel(Model, _Step, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "the fitted step in JSON", TypeConverters.toString)

    @property
    def step(self):
        return transformers.step_of(json.loads(self.getOrDefault("state")))

    def output_names(self) -> list[str]:
        return transformers.renamed(self.step, self.getOrDefault("names"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features = F.col(self.getInputCol())
        return dataset.withColumn(self.getOutputCol(), F.when(features.isNotNull(), self.step.column(features)))


class _Engine(HasInputCol):
    engine = Param(Params._dummy(), "engine", "a name of lifecycle.ENGINES", TypeConverters.toString)
    idCol = Param(Params._dummy(), "idCol", "the column that identifies a row", TypeConverters.toString)
    options = Param(Params._dummy(), "options", "options of the engine in JSON", TypeConverters.toString)
    share = Param(Params._dummy(), "share", "share of training scores that count as benign, for engines without a limit of their own", TypeConverters.toFloat)


class AnomalyEngine(Estimator, _Engine, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, engine: str | None = None, idCol: str | None = None, inputCol: str | None = None, options: str | None = None, share: float | None = None) -> None:
        super().__init__()
        self._setDefault(inputCol="features", options="{}", share=1.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> AnomalyEngineModel:
        make, above, limit = lifecycle.ENGINES[self.getOrDefault("engine")]
        ident, features, options = self.getOrDefault("idCol"), self.getInputCol(), json.loads(self.getOrDefault("options"))
        rows = dataset.where(F.col(features).isNotNull()).select(ident, features)
        if make is neighbours.fit_outlier_factor:
            options = {"path": f"{shared_folder(dataset.sparkSession)}/outlier_factor-{uuid.uuid4().hex}"} | options
        fitted = make(rows, ident, features, **options)
        if fitted is None:
            raise ValueError("no rows to fit")
        if limit is None:
            limit = engines.exact_percentile(lifecycle.score(rows, ident, features, fitted), "score", self.getOrDefault("share"))
        model = AnomalyEngineModel()._set(limit=float(limit), above=above)
        model.fitted = fitted
        return self._copyValues(model)


class AnomalyEngineModel(Model, _Engine, MLReadable, MLWritable):
    """Adds score and label (1 for an attack) to rows."""

    limit = Param(Params._dummy(), "limit", "the score beyond which a row is an attack", TypeConverters.toFloat)
    above = Param(Params._dummy(), "above", "whether attacks lie above the limit", TypeConverters.toBoolean)
    fitted = None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ident, features = self.getOrDefault("idCol"), self.getInputCol()
        model = lifecycle.Model([], self.fitted, self.getOrDefault("limit"), self.getOrDefault("above"))
        return dataset.join(model.classify(dataset.select(ident, features), ident, features), ident)

    def write(self) -> MLWriter:
        return _EngineWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EngineReader()


class _EngineWriter(MLWriter):
    def __init__(self, model: AnomalyEngineModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.sparkSession.createDataFrame(engines.state_rows(self.model.fitted), engines._STATE).write.parquet(f"{path}/data")


class _EngineReader(MLReader):
    def load(self, path: str) -> AnomalyEngineModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = AnomalyEngineModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.fitted = engines.model_of(self.sparkSession.read.schema(engines._STATE).parquet(f"{path}/data").collect())
        return model
