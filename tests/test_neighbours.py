"""Exact neighbours and outlier factors through the index of pivots against plain comparison."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift.operators import engines, neighbours


def _clusters(n: int = 1200, width: int = 4, centres: int = 12, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.normal(scale=20, size=(centres, width))[rng.integers(centres, size=n)] + rng.normal(size=(n, width))
    x[:40] = x[40]  # repeated rows
    x[41:44] *= 9  # far rows
    return x


def _frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)


def _plain(x: np.ndarray, k: int, metric: str, p: float = 2) -> dict:
    d = engines.distance_block(x, x, metric, p, engines.metric_space(x, metric))
    if metric in ("minkowski", "euclidean", "mahalanobis", "seuclidean") and p == 2:
        y = x if engines.metric_space(x, metric) is None else x @ engines.metric_space(x, metric)
        d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return {i: sorted(d[i])[:k] for i in range(len(x))}


@pytest.mark.parametrize("metric, p", [("minkowski", 2), ("minkowski", 3), ("manhattan", 2), ("canberra", 2), ("mahalanobis", 2), ("jaccard", 2), ("cosine", 2)])
def test_neighbours_of_every_kind_of_metric(spark, metric, p):
    x = _clusters(600)
    x = (x > 0).astype(float) if metric == "jaccard" else x
    report = {}
    rows = neighbours.neighbours(_frame(spark, x), "vec_id", "embedding", 5, p, 50, metric, report=report).collect()
    got: dict = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["distance"])
        assert r["query_id"] != r["point_id"]
    want = _plain(x, 5, metric, p)
    assert set(got) == set(want) and all(np.allclose(got[i], want[i], atol=1e-7) for i in want)
    assert (report["met"] == report["pairs"]) == (metric == "cosine") or metric == "jaccard"
    if (metric, p) == ("minkowski", 2):
        assert report["met"] < 0.3 * report["pairs"], report


def test_queries_that_are_not_points(spark):
    x, q = _clusters(500), _clusters(90, seed=6)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "vec_id long, embedding array<double>")
    got = neighbours.knn(queries, _frame(spark, x), 4, block=40, same=False)
    near = {(r["query_id"], r["rank"]): r["distance"] for r in got.collect()}
    d = np.sort(np.sqrt(((q[:, None] - x[None]) ** 2).sum(2)), axis=1)
    assert all(near[i, k + 1] == pytest.approx(d[i, k]) for i in range(90) for k in range(4)) and len(near) == 360


@pytest.mark.parametrize("metric", ["minkowski", "chebyshev", "seuclidean"])
def test_outlier_factors_over_blocks(spark, tmp_path, metric):
    x = _clusters(400)[44:]
    rows = _frame(spark, x)
    want = engines.LocalOutlierFactor.fit(x, 10, metric=metric)
    got = {r["vec_id"]: r["score"] for r in neighbours.local_outlier_factor(rows, "vec_id", "embedding", 10, metric=metric, block=32).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want(x), rtol=1e-5)
    new = _clusters(60, seed=8)
    model = neighbours.fit_outlier_factor(rows, "vec_id", "embedding", f"{tmp_path}/train", 10, metric=metric)
    model = neighbours.StoredOutlierFactor.restored(*model.state())
    scored = model.score(_frame(spark, new).withColumnRenamed("embedding", "f"), "vec_id", "f")
    found = {r["vec_id"]: r["score"] for r in scored.collect()}
    assert np.allclose([found[i] for i in range(60)], want(new), rtol=1e-5)


def test_few_rows(spark, tmp_path):
    one = _frame(spark, np.ones((1, 2)))
    assert neighbours.neighbours(one, "vec_id", "embedding", 3).collect() == []
    assert neighbours.fit_outlier_factor(one.where(F.lit(False)), "vec_id", "embedding", f"{tmp_path}/none") is None
    model = neighbours.fit_outlier_factor(one, "vec_id", "embedding", f"{tmp_path}/one")
    assert len(model.score(one, "vec_id", "embedding").collect()) == 1
    with pytest.raises(ValueError):
        neighbours.neighbours(one, "vec_id", "embedding", 3, metric="none")


def test_smallest_are_those_of_a_stable_sort(monkeypatch):
    r = np.random.default_rng(5)
    for most in (3, 40, 10**6):
        d = r.integers(0, most, (30, 400)).astype(float)
        d[d == 1] = np.inf
        assert np.array_equal(engines._smallest(d, 20), np.argsort(d, axis=1, kind="stable")[:, :20])
    x = r.normal(size=(300, 4))
    want = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)).argsort(axis=1, kind="stable")[:, :5]
    monkeypatch.setattr(engines.np, "argsort", lambda *a, **k: pytest.fail("sorted whole") if a[0].shape[-1] == 300 else a[0].argsort(*a[1:], **k))
    assert np.array_equal(engines._near(x, x, 5, 2, False)[1], want)
