"""Hyper-parameter search: a JSON grid, every combination trained, classified and evaluated over one store, with features kept between runs."""

from __future__ import annotations

import inspect
import itertools
import json
import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.operators import extractors
from flowsift.plans import lifecycle
from flowsift.plans.store import ResultStore

#: Names of options and what they are called here; those with None change no result.
ENGINE_OPTIONS = {
    "training_epochs": "epochs", "training_batch": "batch", "early_stopping_patience": "patience", "dropout_ratio": "dropout", "batch_normalization": "batch_norm", "n_neighbors": "k", "minkowski_p": "p",
    "n_estimators": "trees", "cache_size": "cache_mb", "tolerance": "tol", "shrinking": None, "algorithm": None, "leaf_size": None, "verbose": None,
}
EXTRACTOR_OPTIONS = {"nf_mode": "modes", "flow_timeout": "timeout_us", "subflow_timeout": "subflow_us", "hindsight_window": "hindsight"}


@dataclass(frozen=True)
class Trial:
    index: int
    engine: str
    engine_params: dict
    share: float
    extractor: str
    settings: extractors.FlowSettings
    extractor_params: dict
    transformers: list[str]


def read_grid(path: str) -> dict:
    """The specification in a JSON file; broken JSON and unknown names are errors."""
    with open(path, encoding="utf-8") as f:
        try:
            spec = json.load(f)
        except json.JSONDecodeError as e:
            raise ValueError(f"{path} is no JSON: {e}") from e
    for part, known in (("decision_engine", lifecycle.ENGINES), ("feature_extractor", lifecycle.EXTRACTORS)):
        if spec.get(part, {}).get("name") not in known:
            raise ValueError(f"{part} of {path} is none of {', '.join(known)}")
        if not all(isinstance(v, list) for v in spec[part].get("parameters", {}).values()):
            raise ValueError(f"{part} of {path} has parameters that are no lists")
    return spec


def transformer_lists(node: list) -> list[list[str]]:
    """One list of names, or a list of such lists."""
    if not isinstance(node, list):
        raise ValueError("transformers are no list")
    lists = [node] if not node or isinstance(node[0], str) else node
    for names in lists:
        if not isinstance(names, list) or not all(n in lifecycle.TRANSFORMERS for n in names):
            raise ValueError(f"{names} are not all transformers")
    return lists


def _named(option: str) -> str:
    name = option.removeprefix("--").replace("-", "_")
    return "threshold_percentile" if name and "threshold_percentile".startswith(name) and name.startswith("threshold") else name


def _engine_params(engine: str, options: dict) -> tuple[dict, float]:
    """Keyword arguments of the engine, and the autoencoder's share of benign training errors."""
    accepted = inspect.signature(lifecycle.ENGINES[engine][0]).parameters
    out, share = {}, 1.0
    for option, value in options.items():
        name = _named(option)
        if value is None:
            continue
        if name == "threshold_percentile":
            share = float(value) / 100
            continue
        name = ENGINE_OPTIONS.get(name, name)
        if name is None:
            continue
        if name not in accepted:
            raise ValueError(f"{engine} has no option {option}")
        out[name] = value != "none" if name == "batch_norm" else value
    if not 0 <= share <= 1:
        raise ValueError("threshold-percentile must be between 0 and 100")
    return out, share


def _settings(options: dict, by: tuple[str, ...]) -> tuple[extractors.FlowSettings, dict]:
    """Flow settings, and the options that belong to the payload extractors."""
    own, rest = {}, {}
    for option, value in options.items():
        name = _named(option)
        if value is None:
            continue
        known = EXTRACTOR_OPTIONS.get(name)
        if known == "modes":
            own["modes"] = frozenset(v for v in (value if isinstance(value, list) else [value]) if v)
        elif known:
            own[known] = int(float(value) * 1_000_000) if known.endswith("_us") else int(value)
        else:
            rest[name] = value
    return extractors.FlowSettings(by=by, **own), rest


def trials(spec: dict, by: tuple[str, ...] = ("file",)) -> list[Trial]:
    """Every combination: transformers vary fastest, then the extractor's values, then the engine's, so that kept features are used again soon."""
    axes = [("de", k, v) for k, v in spec["decision_engine"].get("parameters", {}).items()] + [("fe", k, v) for k, v in spec["feature_extractor"].get("parameters", {}).items()]
    engine, extractor = spec["decision_engine"]["name"], spec["feature_extractor"]["name"]
    out = []
    for values, names in itertools.product(itertools.product(*(v for _, _, v in axes)), transformer_lists(spec["transformers"])):
        chosen = {side: {k: v for (s, k, _), v in zip(axes, values) if s == side} for side in ("de", "fe")}
        params, share = _engine_params(engine, chosen["de"])
        settings, rest = _settings(chosen["fe"], by)
        out.append(Trial(len(out), engine, params, share, extractor, settings, rest, names))
    return out


def kept_features(store: ResultStore, trial: Trial, traffic_name: str, packets: DataFrame, training: DataFrame) -> DataFrame:
    """The features of the packets, from the store if they were made before; those of PAYL by the centroids of the training packets."""
    ident = trial.settings.ident + ("" if trial.extractor == "flow_extractor" else f"/{trial.extractor}{json.dumps(trial.extractor_params, sort_keys=True)}")

    def make() -> DataFrame:
        if trial.extractor != "payl_flows":
            return lifecycle.EXTRACTORS[trial.extractor](packets, trial.settings)
        centroids = extractors.fit_payl(training, trial.settings, float(trial.extractor_params.get("clustering", 0)))
        return extractors.payl_flows(packets, centroids, trial.settings, float(trial.extractor_params.get("smoothing", 1e-4)))

    return store.features(ident, traffic_name, make)


def _flow_ids(rows: DataFrame, settings: extractors.FlowSettings):
    return rows.withColumn("flow_id", F.when(F.col("flow_first").isNotNull(), F.concat_ws("|", *[F.col(c).cast("string") for c in settings.flow])))


def run_trial(store: ResultStore, trial: Trial, training: DataFrame, tests: DataFrame, truth: DataFrame, dataset_name: str = "", train_set_name: str = "", test_name: str = "test") -> tuple[str, DataFrame]:
    """One combination: trained on the training packets, all taken as benign, then classified and evaluated on the tests. Returns the model's id and its metrics.

    tests: the columns of packets and record_id; truth: record_id, truth, traffic_name, part_name."""
    settings = trial.settings
    fitted_on = kept_features(store, trial, train_set_name or "train", training, training)
    names = extractors.feature_names(fitted_on, settings)
    vectors = lambda f: _flow_ids(extractors.as_vectors(f, settings), settings).select("flow_id", "features")
    model_id = store.new_id("model", f"{trial.extractor}-{trial.engine}-", 8)
    lifecycle.train(store, model_id, vectors(fitted_on), trial.engine, trial.transformers, trial.engine_params, trial.share, names=names, dataset_name=dataset_name, train_set_name=train_set_name, feature_extractor=trial.extractor)
    store.save_params(trial.extractor, model_id, {"flow_timeout": settings.timeout_us / 1e6, "subflow_timeout": settings.subflow_us / 1e6, "hindsight_window": settings.hindsight} | {m: m in settings.modes for m in extractors.MODES} | trial.extractor_params)
    classification_id = store.new_id("classification_info", f"{model_id}/")
    found = kept_features(store, trial, test_name, tests, training)
    own = _flow_ids(extractors.packet_flows(tests, settings), settings).select(*settings.by, "pkt_idx", "flow_id")
    packets = tests.select(*settings.by, "pkt_idx", "record_id").join(own, [*settings.by, "pkt_idx"], "left").select("record_id", "flow_id")
    lifecycle.classify(store, classification_id, model_id, vectors(found), packets)
    return model_id, lifecycle.evaluate(store, classification_id, truth, dataset_name)


def search(store: ResultStore, spec: dict, read: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], only_index: int | None = None, by: tuple[str, ...] = ("file",), **names: str) -> list[str]:
    """Runs all combinations, or the one of an index, over (training packets, test packets, truth). A combination that fails is logged and left out,
    unless it is the only one. Returns the ids of the models."""
    training, tests, truth = read()
    done = []
    for trial in trials(spec, by):
        if only_index is not None and trial.index != only_index:
            continue
        try:
            done.append(run_trial(store, trial, training, tests, truth, **names)[0])
        except Exception:
            logging.exception("combination %d failed", trial.index)
            if only_index is not None:
                raise
    return done
