"""Training, classification and evaluation over a result store.

Flows have an id and an array of features. Training fits the transformers in their order, then the engine, on benign flows; classifying
scores flows, gives their verdicts to their packets and stores them; evaluating compares stored verdicts with labels. Fitted models are kept as JSON
parameters and arrays in a Parquet table.

Defined cases: training without benign flows is refused, as is a model or classification id that the store already has; null features and
packets without a flow are benign; records without a label are not evaluated. A classification_info row is written after the results, so one that is not there means an unfinished run.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from flowsift.operators import engines, evaluation, extractors, fitting, flows, neighbours, transformers
from flowsift.plans.store import METRICS, ResultStore

#: Fit over all rows, and whether an attack lies above the limit; a limit of None is a share of the training scores.
ENGINES: dict[str, tuple[Callable, bool, float | None]] = {
    "local_outlier_factor": (neighbours.fit_outlier_factor, True, 1.5),
    "isolation_forest": (engines.isolation_forest, True, 0.5),
    "one_class_svm": (fitting.fit_one_class_svm, False, 0.0),
    "autoencoder": (fitting.fit_autoencoder, True, None),
}


def _pca(k: int):
    return lambda rows, features, names: transformers.pca(rows, k, features)


def _one_hot(rows: DataFrame, features: str, names: list[str]):
    return transformers.one_hot_vectors(rows, [i for i, n in enumerate(names) if extractors.feature_type(n) == "categorical"], features)


#: Fitted from rows, the column of features and their names.
TRANSFORMERS: dict[str, Callable] = {
    "minmax_scaler": lambda rows, features, names: transformers.minmax_scaler(rows, features),
    "standard_scaler": lambda rows, features, names: transformers.standard_scaler(rows, features),
    "onehot_encoder": _one_hot,
    "fixed_feature_name_filter": lambda rows, features, names: transformers.fixed_filter(names),
} | {f"pca_reducer_{k}": _pca(k) for k in (2, 10, 20, 30, 50)}
#: From packets and settings to features; those of payl_flows need centroids, made by extractors.fit_payl() of the training packets.
EXTRACTORS: dict[str, Callable] = {"flow_extractor": extractors.flow_features, "flows_payload": extractors.payload_flows, "payl_flows": extractors.payl_flows}

_FITTED = "model_id string, kind string, params string, name string, shape array<int>, data binary"


def score(rows: DataFrame, ident: str, features: str, engine) -> DataFrame:
    """ident, score of every row: by the engine's own table, if it has one, else by tasks that hold the engine."""
    return engine.score(rows, ident, features) if hasattr(engine, "score") else engines.score_rows(rows, ident, features, engine)


@dataclass
class Model:
    """Fitted transformers in their order, the engine and the score from which a flow is an attack."""

    steps: list
    engine: Callable[[np.ndarray], np.ndarray]
    limit: float
    above: bool

    def features(self, column: str):
        out = F.col(column)
        for step in self.steps:
            out = step.column(out)
        return out

    def classify(self, rows: DataFrame, ident: str, column: str = "features") -> DataFrame:
        """ident, score, label of each flow; null features score null and are benign."""
        ready = rows.where(F.col(column).isNotNull()).select(ident, self.features(column).alias("x"))
        scored = score(ready, ident, "x", self.engine)
        over = F.col("score") > self.limit if self.above else F.col("score") < self.limit
        rest = rows.where(F.col(column).isNull()).select(ident, F.lit(None).cast("double").alias("score"))
        return scored.unionAll(rest).withColumn("label", F.coalesce(over.cast("int"), F.lit(0)))

    def rows(self, model_id: str) -> list[tuple]:
        head = {"steps": [transformers.step_state(s) for s in self.steps], "limit": self.limit, "above": self.above}
        return [(model_id, "model", json.dumps(head), "", [], b""), *[(model_id, "engine", *r) for r in engines.state_rows(self.engine)]]

    @classmethod
    def of(cls, rows: list) -> Model:
        head = json.loads(next(r["params"] for r in rows if r["kind"] == "model"))
        return cls([transformers.step_of(s) for s in head["steps"]], engines.model_of([r for r in rows if r["kind"] == "engine"]), head["limit"], head["above"])


def train(store: ResultStore, model_id: str, benign: DataFrame, engine: str, steps: list[str] = (), params: dict | None = None, share: float = 1.0, ident: str = "flow_id", features: str = "features", names: list[str] = (), **info: str) -> Model:
    """Fits on all benign flows, stores the model and its parameters. share is the autoencoder's share of training errors that count as benign. names: of the features, which some transformers need. info: further columns of the model row."""
    if store.exists("model", model_id=model_id):
        raise ValueError(f"model {model_id} exists")
    make, above, limit = ENGINES[engine]
    rows, fitted, names = benign.where(F.col(features).isNotNull()).select(ident, features), [], list(names)
    for name in steps:
        fitted.append(TRANSFORMERS[name](rows, features, names))
        names = transformers.renamed(fitted[-1], names)
        rows = rows.select(ident, fitted[-1].column(F.col(features)).alias(features))
    options = dict(params or {})
    if make is neighbours.fit_outlier_factor:
        options = {"path": f"{store.folder}/outlier_factor/{model_id}"} | options
    fit = make(rows, ident, features, **options)
    if fit is None:
        raise ValueError("no benign flows to train on")
    if limit is None:
        limit = engines.exact_percentile(score(rows, ident, features, fit), "score", share)
    model = Model(fitted, fit, limit, above)
    row = {"model_id": model_id, "decision_engine": engine, "transformers": ",".join(steps), "feature_extractor": info.get("feature_extractor", ""), "dataset_name": info.get("dataset_name", ""), "train_set_name": info.get("train_set_name", ""), "params": json.dumps(options)}
    store.append("model", store.spark.createDataFrame([row], "model_id string, decision_engine string, transformers string, feature_extractor string, dataset_name string, train_set_name string, params string"))
    store.save_params(engine, model_id, options or {"default": True})
    store.append("fitted", store.spark.createDataFrame(model.rows(model_id), _FITTED))
    return model


def load(store: ResultStore, model_id: str) -> Model:
    rows = store.spark.read.schema(_FITTED).option("recursiveFileLookup", True).parquet(f"{store.folder}/fitted").where(F.col("model_id") == model_id).collect()
    if not rows:
        raise ValueError(f"no model {model_id}")
    return Model.of(rows)


def _timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches as they are, with the time that the task waited for them and its whole time, both in the first row of each (the rest of the time in the next)."""
    last = time.monotonic_ns()
    while True:
        asked = time.monotonic_ns()
        batch = next(batches, None)
        if batch is None:
            return
        now = time.monotonic_ns()
        spent = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
        if batch.num_rows:
            spent[0][0], spent[1][0] = now - asked, now - last
            last = now
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, spent)], [*batch.schema.names, "wait_ns", "task_ns"])


def classify(store: ResultStore, classification_id: str, model_id: str, rows: DataFrame, packets: DataFrame, ident: str = "flow_id", record: str = "record_id", features: str = "features") -> None:
    """Stores a verdict for each packet (record id, flow id), and after it the run's times and packets, observed as the packets pass to be written: they are read once.

    The time of reading is the share of their time that the reading tasks waited for packets, of the whole run's time."""
    if store.exists("classification_info", classification_id=classification_id):
        raise ValueError(f"classification {classification_id} exists")
    model, began, seen = load(store, model_id), time.monotonic(), Observation()
    verdicts = model.classify(rows, ident, features).select(ident, "label")
    kinds = dict(packets.dtypes)
    passed = packets.select(record, ident).mapInArrow(_timed, f"`{record}` {kinds[record]}, `{ident}` {kinds[ident]}, wait_ns long, task_ns long")
    passed = passed.observe(seen, F.count(F.lit(1)).alias("packets"), F.sum("wait_ns").alias("wait"), F.sum("task_ns").alias("task"))
    labelled = flows.map_back(passed.select(record, ident), verdicts, [ident])
    out = labelled.select(F.lit(classification_id).alias("classification_id"), F.col(record).cast("string").alias("record_id"), "label")
    store.append("classification_results", out)
    total, found = time.monotonic() - began, seen.get
    read = total * min(1.0, (found["wait"] or 0) / max(1, found["task"] or 0))
    done = (classification_id, model_id, 1, total, read, float(found["packets"]))
    store.append("classification_info", store.spark.createDataFrame([done], "classification_id string, model_id string, is_finished int, total_time double, packet_read_time double, packet_count double"))


def run_totals(info: DataFrame, by: list[str]) -> DataFrame:
    """Times and packets of the runs of each group."""
    return info.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("total_time", "packet_read_time", "packet_count")])


def evaluate(store: ResultStore, classification_id: str, truth: DataFrame, dataset_name: str = "", record: str = "record_id", traffic_names: list[str] | None = None) -> DataFrame:
    """Stores the metrics of each traffic_name and part_name, and per part over all traffic (traffic_name '*', is_aggregated 1), and returns them with the counts tp, fp, tn, fn.

    truth: record, truth (0 or 1), traffic_name, part_name, once for each part that a record is in. traffic_names: only these."""
    verdicts = store.read("classification_results").where(F.col("classification_id") == classification_id).select("record_id", F.col("label").alias("predicted"))
    if traffic_names is not None:
        truth = truth.where(F.col("traffic_name").isin(list(traffic_names)))
    marked = truth.withColumn("record_id", F.col(record).cast("string")).join(verdicts, "record_id")
    cells = evaluation.confusion(marked, ["traffic_name", "part_name"]).withColumn("is_aggregated", F.lit(0))
    total = evaluation.total_confusion(cells, ["part_name"]).withColumns({"traffic_name": F.lit("*"), "is_aggregated": F.lit(1)})
    counts = {"tp": "true_positives", "fp": "false_positives", "tn": "true_negatives", "fn": "false_negatives"}
    rows = evaluation.with_metrics(cells.unionByName(total)).withColumnsRenamed(counts)
    rows = rows.select(F.lit(classification_id).alias("classification_id"), F.lit(dataset_name).alias("dataset_name"), "traffic_name", "is_aggregated", "part_name", *[F.col(f"`{m}`").cast("double").alias(m) for m in METRICS])
    store.append("evaluations", rows)
    found = store.read("evaluations").where(F.col("classification_id") == classification_id)
    return found.withColumns({k: F.col(v).cast("long") for k, v in counts.items()})
