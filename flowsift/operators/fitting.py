"""Fits of the one-class SVM and the autoencoder to all rows of a table.

SVM: a cascade. Parts of the rows are solved by themselves; rows with weight of some parts are solved together, with the weights they have to begin with, and so
on until one set is left. A scan of all rows then looks for rows outside the set that violate the optimum's conditions; the worst of them join the
set, which is solved again, until no row does. That is the condition at which the solver of one task stops, so both agree within its tolerance. The last sets hold
the support vectors, nu times the number of rows at least: with them the model grows, not with the rows.

Autoencoder: synchronous data-parallel training. Rows are dealt once, by a hash of their id, to the steps of an epoch and stored by step. In a step every
task sums the gradients of its rows of that step, the sums are added up, and one step of Adam follows; epochs take the steps in changing order. Patience looks at the
loss of all rows. Batch normalisation takes each task's own rows for its statistics.

Tables that one task can hold (ONE_TASK rows) are fitted by one task, by the same steps. Ids are unique; null features must be left out before.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.functions.scratch import discard, written
from flowsift.operators import engines

ONE_TASK, FAN_IN, WORST = 20_000, 4, 5_000
#: Steps of an epoch at most: beyond batch times as many rows, batches grow.
MOST_STEPS = 200


def _named(rows: DataFrame, ident: str, features: str) -> DataFrame:
    return rows.select(F.col(ident).cast("string").alias("id"), F.col(features).cast("array<double>").alias("x"))


def _solved(nu: float, options: dict):
    """Groups of rows (id, x, weight, stands) to those that have weight, with the rows that the group stands for, and the state of the model."""

    def run(table: pa.Table) -> tuple[engines.OneClassSvm, pa.Table, int]:
        table = table.sort_by([("id", "ascending")])
        x = np.array(table.column("x").to_pylist(), float)
        weight, stands = (table.column(c).to_numpy() for c in ("weight", "stands"))
        total = round(stands.sum())
        # each part's weights sum to 1; together they count by the rows that the parts stand for
        start = None if np.isnan(weight).all() else np.nan_to_num(weight)
        return engines.OneClassSvm(x, nu, total=total, start=start, **options), table, total

    return run


def fit_one_class_svm(rows: DataFrame, ident: str, features: str, nu: float = 0.001, gamma: float = 0.005, kernel: str = "rbf", tol: float = 1e-3, coef0: float = 0.0, degree: int = 3, max_iter: int = -1, cache_mb: float = 500, one_task: int = ONE_TASK, worst: int = WORST) -> engines.OneClassSvm | None:
    """The model of all rows; None without rows."""
    options = {"gamma": gamma, "kernel": kernel, "tol": tol, "coef0": coef0, "degree": degree, "max_iter": max_iter, "cache_mb": cache_mb}
    solve = _solved(nu, options)
    schema = "id string, x array<double>, weight double, stands double, part long"

    def part(key, table):
        svm, table, total = solve(table)
        kept = table.take(pa.array(svm.kept))
        share = np.full(len(svm.kept), total / len(svm.kept))
        return pa.table([kept.column("id"), kept.column("x"), pa.array(svm.alpha), pa.array(share), pa.array(np.full(len(svm.kept), key[0].as_py()))], ["id", "x", "weight", "stands", "part"])

    named = written(_named(rows, ident, features), "svm_rows")
    n = named.count()
    if not n:
        return None
    parts = max(1, -(-n // one_task))
    held = named.select("id", "x", F.lit(float("nan")).alias("weight"), F.lit(1.0).alias("stands"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
    while parts > 1:
        solved = written(held.groupBy("part").applyInArrow(part, schema), "svm_part")
        parts = -(-parts // FAN_IN)
        # a part counts in its group by the share of the rows that it stands for
        size = solved.groupBy("part").agg(F.sum("stands").alias("size")).withColumn("above", F.floor(F.col("part") / FAN_IN))
        whole = size.groupBy("above").agg(F.sum("size").alias("whole"))
        size = size.join(whole, "above").select(F.col("part").alias("old"), "size", "whole", "above")
        held = solved.join(F.broadcast(size), F.col("part") == F.col("old")).select("id", "x", (F.col("weight") * F.col("size") / F.col("whole")).alias("weight"), "stands", F.col("above").alias("part"))
        held = written(held, "svm_part")
        discard(solved)

    while True:
        # rows that came after the cascade stand for none but themselves, which the total has already
        def last(table: pa.Table) -> pa.Table:
            svm, table, _ = solve(table.set_column(table.schema.get_field_index("stands"), "stands", pa.array(np.full(table.num_rows, n / table.num_rows))))
            return engines.state_table(svm)

        svm = engines.model_of(held.groupBy("part").applyInArrow(last, engines._STATE).collect())
        if held.count() >= n:
            return svm
        outside = engines.score_rows(named, "id", "x", svm, "score").where(F.col("score") < svm.top - svm.rho - tol)
        more = outside.join(held.select("id"), "id", "left_anti").orderBy("score").limit(worst)  # the next round finds what is left
        more = written(more.join(named, "id").select("id", "x"), "svm_violators")
        if more.isEmpty():
            return svm
        support = {s.tobytes(): a for s, a in zip(svm.support, svm.alpha)}

        def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                weight = [support.get(np.array(x, float).tobytes(), 0.0) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(weight, pa.float64())], ["id", "x", "weight"])

        known = held.select("id", "x").mapInArrow(weighted, "id string, x array<double>, weight double").where("weight > 0")
        held = written(known.unionByName(more.withColumn("weight", F.lit(0.0))).select("id", "x", "weight", F.lit(1.0).alias("stands"), F.lit(0).cast("long").alias("part")), "svm_part")


def _packed(arrays: list[np.ndarray]) -> bytes:
    return np.concatenate([a.ravel() for a in arrays]).astype(np.float64).tobytes()


def _unpacked(data: bytes, like: list[np.ndarray]) -> list[np.ndarray]:
    flat, out, at = np.frombuffer(data), [], 0
    for a in like:
        out.append(flat[at : at + a.size].reshape(a.shape))
        at += a.size
    return out


def _weights(auto: engines.Autoencoder) -> list[np.ndarray]:
    return [layer.params[k] for layer in auto.net for k in layer.params]


def _moving(auto: engines.Autoencoder) -> list[np.ndarray]:
    return [layer.moving[k] for layer in auto.net for k in getattr(layer, "moving", {})]


def _one_step(auto: engines.Autoencoder, x: np.ndarray, seed: list[int]) -> tuple[float, int, list[np.ndarray], list[np.ndarray]]:
    """Summed loss, rows, summed gradients and moving statistics after some rows (times their number)."""
    error, grads = auto.gradients(x, np.random.default_rng(seed))
    return error, len(x), grads, [m * len(x) for m in _moving(auto)]


def _trained(auto: engines.Autoencoder, n: int, steps: int, epochs: int, seed: int, at: Callable[[int, list[int]], tuple]) -> engines.Autoencoder:
    """Epochs over all steps. at: _one_step() of a step, summed over its tasks."""
    for epoch in range(epochs):
        total = 0.0
        for k in np.random.default_rng([seed + 1, epoch]).permutation(steps).tolist():
            error, size, grads, moving = at(k, [seed + 2, epoch, k])
            if size:
                total += error
                for old, new in zip(_moving(auto), moving):
                    old[...] = new / size
                auto.step([g / size for g in grads])
        if auto.finished(total / n):
            break
    auto.end()
    return auto


def fit_autoencoder(rows: DataFrame, ident: str, features: str, layers: str = "*0.7,*0.8,#1", activation: str = "relu", epochs: int = 50, batch: int = 256, loss: str = "mse", rate: float = 1e-3, seed: int = 0, dropout: float = -1, batch_norm: bool = False, patience: int = -1, one_task: int = ONE_TASK, most_steps: int = MOST_STEPS) -> engines.Autoencoder | None:
    """The model of all rows; None without rows."""
    named = _named(rows, ident, features)
    n = named.count()
    if not n:
        return None
    steps = max(1, min(most_steps, -(-n // batch)))
    dealt = named.withColumn("step", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(steps)).cast("int"))
    options = {"layers": layers, "activation": activation, "loss": loss, "rate": rate, "seed": seed, "dropout": dropout, "batch_norm": batch_norm, "patience": patience}
    if n <= one_task:

        def whole(table: pa.Table) -> pa.Table:
            table = table.sort_by([("id", "ascending")])
            x, step = np.array(table.column("x").to_pylist(), float), table.column("step").to_numpy()
            auto = engines.Autoencoder.untrained(x.shape[1], **options)
            parts = [x[step == k] for k in range(steps)]
            _trained(auto, len(x), steps, epochs, seed, lambda k, own: _one_step(auto, parts[k], [*own, 0]) if len(parts[k]) else (0.0, 0, [], []))
            auto.params = auto.params | {"history": auto.history}
            return engines.state_table(auto)

        return engines.model_of(dealt.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(whole, engines._STATE).collect())

    spark = rows.sparkSession
    files = -(-n // (steps * 5 * one_task))
    stored = written(dealt.repartition(steps * files, "step", F.pmod(F.hash("id"), F.lit(files))), "autoencoder_rows", "step")
    auto = engines.Autoencoder.untrained(len(stored.select("x").first()["x"]), **options)
    folder = stored.inputFiles()[0].rsplit("/step=", 1)[0]

    def at(k: int, own: list[int]) -> tuple:
        sent = spark.sparkContext.broadcast(auto.state())
        kinds = "error double, size long, grads binary, moving binary"

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            ids, parts = [], []
            for b in batches:
                ids += b.column(0).to_pylist()
                parts += b.column(1).to_pylist()
            if ids:
                model = engines.Autoencoder.restored(*sent.value)
                order = sorted(range(len(ids)), key=ids.__getitem__)
                error, size, grads, moving = _one_step(model, np.array(parts, float)[order], [*own, TaskContext.get().partitionId()])
                yield pa.RecordBatch.from_arrays([pa.array([error]), pa.array([size]), pa.array([_packed(grads)]), pa.array([_packed(moving) if moving else b""])], ["error", "size", "grads", "moving"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["error"], r["size"]))
            if found:
                sums = [np.sum([np.frombuffer(r[c]) for r in found], axis=0).tobytes() for c in ("grads", "moving")]
                yield pa.RecordBatch.from_arrays([pa.array([sum(r["error"] for r in found)]), pa.array([sum(r["size"] for r in found)]), *(pa.array([s], pa.binary()) for s in sums)], ["error", "size", "grads", "moving"])

        mine = spark.read.schema("id string, x array<double>").parquet(f"{folder}/step={k}") if k in present else None
        if mine is None:
            return 0.0, 0, [], []
        sums = mine.mapInArrow(summed, kinds)
        tasks = len(mine.inputFiles())
        while tasks > 1:  # sums are added up by a tree, of which the driver gets the root
            tasks = math.ceil(tasks / (FAN_IN * FAN_IN))
            sums = sums.repartition(tasks).mapInArrow(added, kinds)
        found = sums.collect()
        sent.unpersist()
        grads, moving = ([np.sum(x, axis=0) for x in zip(*(_unpacked(r[c], like(auto)) for r in found))] for c, like in (("grads", _weights), ("moving", _moving)))
        return sum(r["error"] for r in found), sum(r["size"] for r in found), grads, moving

    present = {r["step"] for r in stored.select("step").distinct().collect()}
    return _trained(auto, n, steps, epochs, seed, at)
