"""Hyper-parameter grids, evaluation grouping and reports as plain tables."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsift.functions.columns import shortened

#: Metrics a report keeps, and their short names.
IMPORTANT = ["f1_score", "mcc", "balanced_accuracy", "precision", "recall", "false_positives", "false_negatives", "support", "part_name", "traffic_name", "dataset_name", "train_dataset", "train_set_name", "classification_ms_per_packet"]
SHORT = {"f1_score": "F1", "mcc": "MCC", "balanced_accuracy": "BA", "precision": "PR", "false_positives": "FP", "false_negatives": "FN", "true_positives": "TP", "true_negatives": "TN", "support": "N", "recall": "RC"}


def grid(spark: SparkSession, engine: dict[str, list], extractor: dict[str, list], transformers: list[list[str]]) -> DataFrame:
    """index and one text column per parameter; transformers vary fastest, then the extractor's values, then the engine's."""
    axes = [(f"de_{k}", v) for k, v in engine.items()] + [(f"fe_{k}", v) for k, v in extractor.items()] + [("transformers", [",".join(t) for t in transformers])]
    rows = [(i, *map(str, combo)) for i, combo in enumerate(itertools.product(*(v for _, v in axes)))]
    return spark.createDataFrame(rows, ", ".join(["index int", *(f"`{n}` string" for n, _ in axes)]))


def transformer_indicators(rows: DataFrame, names: list[str], column: str = "transformers") -> DataFrame:
    have = F.split(column, ",")
    return rows.select("*", *[F.array_contains(have, n).cast("int").alias(n) for n in names])


def constant_columns(rows: DataFrame, columns: list[str]) -> list[str]:
    """Columns with at most one value, null counted as one, found in one pass."""
    counts = rows.agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(c) for c in columns]).first()
    return [c for c in columns if (counts[c] or 0) <= 1]


def top_by_metric(rows: DataFrame, groups: list[str], metrics: list[str], tie: list[str], k: int = 30) -> DataFrame:
    """The k best rows of each group and metric, with the metric's name and rank."""
    long = rows.select(*groups, *tie, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("m")).select(*groups, *tie, "m.*")
    order = Window.partitionBy(*groups, "metric").orderBy(F.desc("value"), *tie)
    return long.where(F.col("value").isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hyperparam_groups(rows: DataFrame, variable: str, fixed: list[str], values: list[str]) -> DataFrame:
    """For each tuple of the fixed parameters, the ordered list of (variable, values)."""
    return rows.groupBy(*fixed).agg(F.sort_array(F.collect_list(F.struct(variable, *values))).alias("series"))


def report(rows: DataFrame, hyper: list[str], query: str | None = None, all_metrics: bool = False) -> DataFrame:
    """Constant hyper-parameters dropped, important metrics kept, short names; query is a SQL condition on the result."""
    out = rows.drop(*constant_columns(rows, hyper)) if hyper else rows
    if not all_metrics:
        out = out.select([c for c in out.columns if c in hyper or c in IMPORTANT])
    out = out.withColumnsRenamed(SHORT | {h: h.lower() for h in hyper})
    return out.where(query) if query else out


def evaluations_by_model(evaluations: DataFrame, info: DataFrame, models: DataFrame, *params: DataFrame) -> DataFrame:
    """Aggregated evaluations with their run, model and parameter rows, and milliseconds per packet without reading."""
    out = evaluations.where("is_aggregated = 1").join(info, "classification_id").join(models, "model_id")
    for p in params:
        out = out.join(p, "model_id")
    ms = 1000 * (F.col("total_time") - F.col("packet_read_time")) / F.nullif(F.col("packet_count"), F.lit(0))
    return out.withColumn("classification_ms_per_packet", ms)


def write_report(rows: DataFrame, path: str) -> None:
    """A CSV with a header; commas and lists stay inside their fields."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


#: Metrics that the ranked report goes by.
RANKED = ["f1_score", "mcc", "kappa", "precision", "recall"]


def ranked_report(rows: DataFrame, metrics: list[str] = RANKED, k: int = 30) -> DataFrame:
    """An object for each training set and part: under each metric its k best evaluations, best first."""
    known = [m for m in metrics if m in rows.columns]
    top = top_by_metric(rows, ["traffic_name", "part_name"], known, ["classification_id"], k)
    lists = top.groupBy("traffic_name", "part_name", "metric").agg(F.array_sort(F.collect_list(F.struct("rank", "classification_id", "value"))).alias("best"))
    return lists.groupBy(F.concat_ws("_", "traffic_name", "part_name").alias("group")).agg(F.map_from_entries(F.collect_list(F.struct("metric", "best"))).alias("metrics"))


def write_json(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Objects with their fields in order; a path that exists is refused unless overwrite."""
    ordered = rows.select(*[F.col(f"`{c}`") for c in sorted(rows.columns)])
    ordered.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").json(path)


def listed_evaluations(evaluations: DataFrame, model_id: str | None = None, classification_id: str | None = None) -> DataFrame:
    """The aggregated evaluations of a model, else of the part all; long names are cut."""
    rows = evaluations.where("is_aggregated = 1")
    rows = rows.where(F.col("model_id") == model_id) if model_id is not None else rows.where("part_name = 'all'")
    if classification_id is not None:
        rows = rows.where(F.col("classification_id") == classification_id)
    return rows.select("classification_id", shortened(F.col("decision_engine")).alias("decision_engine"), shortened(F.col("feature_extractor")).alias("feature_extractor"), "part_name", "precision", "mcc")


#: Hyper-parameters that no grouping goes by, for all engines and for the autoencoder.
IGNORED, IGNORED_FOR = ["model_id"], {"autoencoder": ["threshold", "layer_sizes"]}


def without_ignored(rows: DataFrame, engine: str | None = None) -> DataFrame:
    return rows.drop(*IGNORED, *IGNORED_FOR.get(engine, []))


def metric_series(rows: DataFrame, variable: str, fixed: list[str], metrics: list[str] = ("precision", "mcc", "f1_score", "recall")) -> DataFrame:
    """What a plot of metrics over a hyper-parameter shows: for each tuple of the fixed ones and metric the points (variable, value), in order."""
    long = rows.select(variable, *fixed, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("m"))
    return long.groupBy(*fixed, "m.metric").agg(F.sort_array(F.collect_list(F.struct(variable, "m.value"))).alias("points"))


def recall_points(rows: DataFrame, variable: str, fixed: list[str], across: int = 5) -> DataFrame:
    """What a plot of recall over false discoveries shows: for each attack category (data set, traffic, part) its cell in a grid `across` wide, and for each
    tuple of the fixed parameters the points (fdr, recall, variable), in order of the variable."""
    category = ["dataset_name", "traffic_name", "part_name"]
    rest = [c for c in fixed if c not in category]
    points = rows.groupBy(*category, *rest).agg(F.transform(F.sort_array(F.collect_list(F.struct(variable, "fdr", "recall"))), lambda p: F.struct(p["fdr"], p["recall"], p[variable])).alias("points"))
    place = F.dense_rank().over(Window.orderBy(*category)) - 1  # categories are few
    cells = rows.select(*category).distinct().withColumns({"grid_row": F.floor(place / across) + 1, "grid_column": place % across + 1})
    return points.join(cells, category)
