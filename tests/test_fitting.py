"""Engines fitted to all rows against the fits of one task, and exact percentiles."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift.operators import engines, fitting, transformers
from flowsift.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def _frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "flow_id long, features array<double>").repartition(3)


@pytest.mark.parametrize("kernel, nu", [("rbf", 0.05), ("rbf", 0.3), ("linear", 0.1)])
def test_svm_by_a_cascade(spark, kernel, nu):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 3)) * [1, 2, 0.5] + (rng.random((900, 1)) < 0.3) * 4
    x[:20] = x[20]  # repeated rows
    rows = _frame(spark, x)
    one = engines.OneClassSvm(x, nu, 0.2, kernel, tol=1e-4)
    for worst in (1000, 7):
        svm = fitting.fit_one_class_svm(rows, "flow_id", "features", nu, 0.2, kernel, tol=1e-4, one_task=120, worst=worst)
        assert np.allclose(svm(x), one(x), atol=5e-4 * max(1, np.abs(one(x)).max())), np.abs(svm(x) - one(x)).max()
        assert svm.alpha.sum() == pytest.approx(1) and svm.alpha.max() <= 1 / (nu * 900) * (1 + 1e-6)
    assert (svm(x) < -1e-3).mean() <= nu + 0.01
    same = engines.model_of([dict(zip(("params", "name", "shape", "data"), r)) for r in engines.state_rows(svm)])
    assert np.array_equal(same(x), svm(x))
    assert fitting.fit_one_class_svm(rows.where(F.lit(False)), "flow_id", "features") is None


@pytest.mark.parametrize("options", [{}, {"dropout": 0.1, "patience": 1, "rate": 0.05}, {"batch_norm": True}])
def test_autoencoder_by_steps_of_all_tasks(spark, options):
    x = np.random.default_rng(2).normal(size=(300, 4))
    rows = _frame(spark, x)
    one = fitting.fit_autoencoder(rows, "flow_id", "features", epochs=3, batch=100, **options)
    # one file a step: the same rows in the same order, and so the same losses and weights
    many = fitting.fit_autoencoder(rows, "flow_id", "features", epochs=3, batch=100, one_task=100, **options)
    assert np.allclose(one.history, many.history) and len(one.history) >= 1
    assert np.allclose(one(x), many(x))
    assert one.history[-1] < one.history[0] or options
    assert fitting.fit_autoencoder(rows.where(F.lit(False)), "flow_id", "features") is None


def test_gradients_of_several_tasks_are_summed(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(600, 3))
    rows = _frame(spark, x)
    one = fitting.fit_autoencoder(rows, "flow_id", "features", epochs=2, batch=600)
    several = fitting.fit_autoencoder(rows, "flow_id", "features", epochs=2, batch=600, one_task=20)  # six files in the one step
    assert np.allclose(one.history, several.history) and np.allclose(one(x), several(x))
    monkeypatch.setattr(fitting, "FAN_IN", 2)
    tree = fitting.fit_autoencoder(rows, "flow_id", "features", epochs=1, batch=600, one_task=20)
    assert np.allclose(tree.history, one.history[:1])


@pytest.mark.parametrize("kind", ["normal", "ties", "two", "heavy", "constant", "wide"])
def test_exact_percentiles(spark, kind):
    rng = np.random.default_rng(4)
    n = 5000
    v = {"normal": rng.normal(size=n), "ties": rng.integers(0, 4, n).astype(float), "two": np.repeat([1.0, 2.0], n // 2), "heavy": np.r_[np.zeros(n - 300), rng.random(300)], "constant": np.full(n, 3.0), "wide": 10.0 ** rng.uniform(-300, 300, n)}[kind]
    rows = spark.createDataFrame([(float(x),) for x in v] + [(None,), (None,)], "v double")
    rows = rows.repartition(3).cache()
    for share in (0.0, 0.37, 0.5, 0.94, 0.99, 1.0):
        assert engines.exact_percentile(rows, "v", share, most=60) == pytest.approx(np.quantile(v, share), rel=1e-12), share
    assert engines.exact_percentile(rows.where("v IS NULL"), "v", 0.5) is None
    one = engines.over_percentile(rows, "v", 0.9)
    assert one.where("label = 1").count() == (v > np.quantile(v, 0.9)).sum()


def test_forest_by_a_share(spark):
    x = np.random.default_rng(5).normal(size=(400, 3))
    rows = _frame(spark, x)
    forest = engines.isolation_forest(rows, "flow_id", "features", trees=5, max_samples=0.1, bootstrap=True)
    assert forest.size == 40 and len(forest.trees) == 5
    assert engines.isolation_forest(rows.where(F.lit(False)), "flow_id", "features") is None


def _matrix(spark) -> tuple[list[int], np.ndarray]:
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy(F.col("vec_id").cast("string")).collect()
    return [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)


def test_engine_queries_against_plain_fits(spark):
    """q_one_class_svm, q_autoencoder and q_isolation_forest on whole tables against models that are fitted and applied in this process."""
    ids, x = _matrix(spark)
    svm = engines.OneClassSvm(x, nu=0.05, gamma=0.5)
    got = {r["vec_id"]: r for r in catalogue.QUERIES["q_one_class_svm"](spark, SMALL).collect()}
    assert np.allclose([got[i]["score"] for i in ids], svm(x), atol=1e-9) and all(got[i]["label"] == (got[i]["score"] < 0) for i in ids)

    step = {r["vec_id"]: r["s"] for r in spark.createDataFrame([(i,) for i in ids], "vec_id long").select("vec_id", F.pmod(F.xxhash64(F.lit(0), F.col("vec_id").cast("string")), F.lit(2)).alias("s")).collect()}
    parts = [x[[step[i] == k for i in ids]] for k in (0, 1)]
    auto = engines.Autoencoder.untrained(x.shape[1])
    for epoch in range(10):
        for k in np.random.default_rng([1, epoch]).permutation(2):
            error, grads = auto.gradients(parts[k], np.random.default_rng(0))
            auto.step([g / len(parts[k]) for g in grads])
    want = auto(x)
    got = {r["vec_id"]: r for r in catalogue.QUERIES["q_autoencoder"](spark, SMALL).collect()}
    assert np.allclose([got[i]["score"] for i in ids], want)
    assert [got[i]["label"] for i in ids] == (want > np.quantile(want, 0.99)).astype(int).tolist()

    draw = {(r["t"], r["vec_id"]): r["d"] for r in spark.createDataFrame([(i,) for i in ids], "vec_id long").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("t")).select("vec_id", "t", F.xxhash64(F.lit(0), "t", "vec_id").alias("d")).collect()}
    depths = np.zeros(len(x))
    for t in range(100):
        own = sorted(range(len(ids)), key=lambda k: (draw[t, ids[k]], str(ids[k])))[:256]
        tree = engines.IsolationForest(x[own], 1, 256, 0.5, t).trees[0]
        for k, v in enumerate(x):  # a walk from the root
            node, depth = 0, 0
            while tree[node][0] >= 0:
                node, depth = int(tree[node][2] if v[int(tree[node][0])] <= tree[node][1] else tree[node][3]), depth + 1
            depths[k] += depth + tree[node][4]
    want = 2 ** (-depths / 100 / engines.IsolationForest.average(256))
    got = {r["vec_id"]: r for r in catalogue.QUERIES["q_isolation_forest"](spark, SMALL).collect()}
    assert np.allclose([got[i]["score"] for i in ids], want)


def test_pca_query_against_plain(spark):
    ids, x = _matrix(spark)
    got = {r["vec_id"]: r["pca"] for r in catalogue.QUERIES["q_pca_variance"](spark, SMALL).collect()}
    values, vectors = np.linalg.eigh(np.cov((x - x.mean(0)).T))
    want = (x - x.mean(0)) @ vectors[:, np.argsort(-values)[:10]]
    got = np.array([got[i] for i in ids])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_vocabularies_have_a_bound(spark):
    rows = spark.createDataFrame([(f"v{i % 12}", [float(i % 12)]) for i in range(40)] + [(None, None)], "a string, features array<double>")
    assert transformers.vocabulary(rows, "a", 12) == sorted(f"v{i}" for i in range(12))
    with pytest.raises(ValueError, match="more than 11"):
        transformers.vocabulary(rows, "a", 11)
    assert transformers.one_hot_vectors(rows.where("a IS NOT NULL"), [0]).values == {0: [float(i) for i in range(12)]}


def test_scores_hold_few_kernel_values():
    import tracemalloc

    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 3))
    svm = engines.OneClassSvm(x[:3000], 0.9, 0.5)
    want = np.exp(-0.5 * ((x[:50, None] - svm.support[None]) ** 2).sum(2)) @ svm.alpha - svm.rho
    tracemalloc.start()
    got = svm(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got[:50], want) and len(svm.support) > 2500 and most < 60e6


def test_a_step_sends_one_row_to_the_driver(spark, monkeypatch):
    rows, seen, real = _frame(spark, np.random.default_rng(7).normal(size=(600, 3))), [], fitting._unpacked
    monkeypatch.setattr(fitting, "_unpacked", lambda data, like: seen.append(len(data)) or real(data, like))
    fitting.fit_autoencoder(rows, "flow_id", "features", epochs=2, batch=600, one_task=20)  # six files in the one step
    assert len(seen) == 2 * 2
