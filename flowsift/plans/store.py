"""Result store: append-only Parquet tables below one folder.

An append is written to a staging folder, which readers pass over, and becomes visible as a whole by one rename to the next commit of its table. Writers claim
the number of a commit by making a file that must not exist yet, after their keys have been checked against all commits before it; so of two writers with the
same keys one fails, and an append that fails leaves nothing that is read.

Tables of older schema versions are read with defaults for the columns that they lack; migrate() records the version that readers may expect.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 3
#: The columns of the stored tables; hyper-parameters have a table for each component.
METRICS = ["precision", "balanced_accuracy", "mcc", "f1_score", "accuracy", "kappa", "fdr", "fnr", "for", "fpr", "tnr", "false_negatives", "false_positives", "true_negatives", "true_positives", "negatives", "positives", "npv", "recall", "support"]
TABLES = {
    "model": "model_id string, decision_engine string, transformers string, feature_extractor string, dataset_name string, train_set_name string, params string",
    "classification_info": "classification_id string, model_id string, is_finished int, total_time double, packet_read_time double, packet_count double",
    "classification_results": "classification_id string, record_id string, label int",
    "extracted_features": "fe_id string, traffic_name string, path string, model_id string",
    "evaluations": "classification_id string, dataset_name string, traffic_name string, is_aggregated int, part_name string, " + ", ".join(f"`{m}` double" for m in METRICS),
    "db_version": "version int",
}
KEYS = {"model": ["model_id"], "classification_info": ["classification_id"], "classification_results": ["classification_id", "record_id"], "extracted_features": ["fe_id", "traffic_name"], "evaluations": ["classification_id", "traffic_name", "part_name"]}
#: Columns that came with later versions, with what older rows have in them.
DEFAULTS = {"is_finished": -1, "packet_count": -1.0, "packet_read_time": -1.0, "total_time": -1.0, "is_aggregated": 0}
SINCE = {2: {"classification_info": ["is_finished", "packet_count", "packet_read_time", "total_time"]}, 3: {"evaluations": ["is_aggregated", "dataset_name"], "model": ["train_set_name", "dataset_name"]}}


class ResultStore:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        """A table, empty if nothing was written; columns that its files lack have their defaults."""
        try:
            rows = self.parquet(name)
        except AnalysisException:
            return self.spark.createDataFrame([], TABLES[name])
        if name not in TABLES:
            return rows
        kinds = self.spark.createDataFrame([], TABLES[name]).dtypes
        filled: list[Column] = []
        for column, kind in kinds:
            value = F.lit(DEFAULTS.get(column)).cast(kind)
            filled.append((F.coalesce(F.col(f"`{column}`").cast(kind), value) if column in rows.columns else value).alias(column))
        return rows.select(*filled, *[f"`{c}`" for c in rows.columns if c not in dict(kinds)])

    def parquet(self, name: str) -> DataFrame:
        """All commits of a table as they are; an error if there is none."""
        return self.spark.read.options(mergeSchema=True, recursiveFileLookup=True).parquet(f"{self.folder}/{name}")

    def _files(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _names(self, name: str) -> set[str]:
        fs, path = self._files(f"{self.folder}/{name}")
        return {f.getPath().getName() for f in fs.listStatus(path)} if fs.exists(path) else set()

    def append(self, name: str, rows: DataFrame, patience: float = 60) -> None:
        """One commit. Keys that the table has are an error; patience: seconds to wait for a commit that another writer has claimed and not made (after that it is taken for lost)."""
        staging = f"{self.folder}/{name}/_staging-{uuid.uuid4().hex}"
        fs, staged = self._files(staging)
        try:
            rows.write.parquet(staging)
            began = time.monotonic()
            while True:
                names = self._names(name)
                claimed = {int(n.removeprefix("_claim-")) for n in names if n.startswith("_claim-")}
                open_ = {n for n in claimed if f"commit-{n:08d}" not in names}
                if open_ and time.monotonic() - began < patience:
                    time.sleep(0.2)
                    continue
                mine = max(claimed, default=-1) + 1
                if name in KEYS and not self.spark.read.parquet(staging).join(self.read(name).select(*KEYS[name]), KEYS[name], "left_semi").isEmpty():
                    raise ValueError(f"{name} already has some of these keys")
                if fs.createNewFile(self._files(f"{self.folder}/{name}/_claim-{mine:08d}")[1]):
                    break
            if not fs.rename(staged, self._files(f"{self.folder}/{name}/commit-{mine:08d}")[1]):
                raise OSError(f"{name}: commit {mine} failed")
        finally:
            fs.delete(staged, True)

    def save_params(self, component: str, model_id: str, params: dict) -> None:
        """One row of a component's parameters; columns may grow from model to model."""
        row = {"model_id": model_id} | {k: json.dumps(v) if isinstance(v, (list, dict)) else v for k, v in params.items()}
        self.append(component, self.spark.createDataFrame([row]))

    def exists(self, name: str, **key) -> bool:
        rows = self.read(name)
        for k, v in key.items():
            rows = rows.where(F.col(k) == v)
        return not rows.isEmpty()

    def counts(self) -> DataFrame:
        """Classifications with the number of their results."""
        return with_counts(self.read("classification_info"), self.read("classification_results"))

    def evaluations(self) -> DataFrame:
        """Every evaluation with its model's parts."""
        return with_models(self.read("evaluations"), self.read("classification_info"), self.read("model"))

    def model_info(self, model_id: str) -> dict:
        """The model's row and its parameters by component; an error if there is none."""
        row = self.read("model").where(F.col("model_id") == model_id).first()
        if row is None:
            raise ValueError(f"no model {model_id}")
        out = {"model": row.asDict()}
        for component in {row["decision_engine"], row["feature_extractor"]} - {"", None}:
            try:
                found = self.parquet(component).where(F.col("model_id") == model_id).first()
                out[component] = found.asDict() if found else {}
            except AnalysisException:
                out[component] = {}
        return out

    def new_id(self, table: str, base: str, digits: int = 4) -> str:
        """base and some digits that no row of the table has as its key yet."""
        key = KEYS[table][0]
        while self.exists(table, **{key: (found := f"{base}{uuid.uuid4().hex[:digits]}")}):
            pass
        return found

    def features_path(self, fe_id: str, traffic_name: str) -> str:
        return f"{self.folder}/features/{hashlib.sha256(json.dumps([fe_id, traffic_name]).encode()).hexdigest()[:24]}"

    def features(self, fe_id: str, traffic_name: str, make) -> DataFrame:
        """The features that are kept under these names; made, written and listed if there are none."""
        path = self.features_path(fe_id, traffic_name)
        if not self.exists("extracted_features", fe_id=fe_id, traffic_name=traffic_name):
            make().write.mode("overwrite").parquet(path)
            self.append("extracted_features", self.spark.createDataFrame([(fe_id, traffic_name, path, None)], TABLES["extracted_features"]))
        return self.spark.read.parquet(path)

    def version(self) -> int:
        """The last recorded version; stores without one are of this version."""
        return self.read("db_version").agg(F.max("version")).first()[0] or VERSION

    def migrate(self, old: int, new: int = VERSION) -> list[str]:
        """Records the new version and names the columns that come with it; an error if nothing lies between."""
        added = [f"{table}.{c}" for v, tables in SINCE.items() if old < v <= new for table, columns in tables.items() for c in columns]
        if not added:
            raise ValueError(f"cannot migrate from version {old} to {new}")
        self.append("db_version", self.spark.createDataFrame([(new,)], TABLES["db_version"]))
        return added


def with_counts(info: DataFrame, results: DataFrame, key: str = "classification_id") -> DataFrame:
    """info with n_results, the number of results of its key; 0 without any."""
    n = results.groupBy(key).agg(F.count("*").alias("n_results"))
    return info.join(n, key, "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))


def with_models(evaluations: DataFrame, info: DataFrame, models: DataFrame) -> DataFrame:
    """Evaluations with the model that made their classification: model_id, decision_engine, feature_extractor, transformers."""
    named = models.select("model_id", "decision_engine", "feature_extractor", "transformers")
    return evaluations.join(info.select("classification_id", "model_id"), "classification_id").join(named, "model_id")
