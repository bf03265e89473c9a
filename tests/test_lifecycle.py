"""Training, classification and evaluation over a store, on flows in two clusters."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift.operators import engines, transformers

from flowsift.plans import lifecycle, reporting, tuning
from flowsift.plans.store import ResultStore


def flows_of(spark, far: bool, n: int, start: int):
    rng = np.random.default_rng(start)
    x = rng.normal(0, 1, (n, 3)) + (12 if far else 0)
    return spark.createDataFrame([(start + i, v.tolist()) for i, v in enumerate(x)], "flow_id long, features array<double>")


@pytest.mark.parametrize(("engine", "steps", "params"), [("local_outlier_factor", ["minmax_scaler"], {"k": 10}), ("isolation_forest", [], {"trees": 50}), ("one_class_svm", ["standard_scaler"], {"nu": 0.05, "gamma": 0.1}), ("autoencoder", ["standard_scaler", "pca_reducer_2"], {"epochs": 40, "layers": "#0,#1"})])
def test_train_classify_evaluate(spark, tmp_path, engine, steps, params):
    store = ResultStore(spark, f"file://{tmp_path}")
    made = lifecycle.train(store, "m", flows_of(spark, False, 300, 0), engine, steps, params, dataset_name="d", feature_extractor="flow_extractor")
    rows = flows_of(spark, False, 60, 1000).unionAll(flows_of(spark, True, 40, 2000)).unionAll(spark.createDataFrame([(9000, None)], "flow_id long, features array<double>"))
    packets = rows.select(F.concat(F.lit("p"), "flow_id").alias("record_id"), "flow_id").unionAll(spark.createDataFrame([("lone", None)], "record_id string, flow_id long"))
    lifecycle.classify(store, "c", "m", rows, packets)
    truth = packets.select("record_id", F.coalesce((F.col("flow_id").between(2000, 2999)).cast("int"), F.lit(0)).alias("truth"), F.lit("t").alias("traffic_name"), F.lit("all").alias("part_name"))
    got = {r["traffic_name"]: r for r in lifecycle.evaluate(store, "c", truth, "d").collect()}
    assert got["*"]["is_aggregated"] == 1 and got["t"]["is_aggregated"] == 0
    assert sum(got["*"][c] for c in ("tp", "fp", "tn", "fn")) == 102
    # of forests of 50 trees on such rows, 0.75 to 0.9 of the benign ones lie below 0.5, by the seed
    assert got["*"]["recall"] > 0.9 and got["*"]["tnr"] > (0.7 if engine == "isolation_forest" else 0.8)
    verdict = {r["record_id"]: r["label"] for r in store.read("classification_results").collect()}
    assert verdict["lone"] == 0 and verdict["p9000"] == 0
    assert store.counts().first()["n_results"] == 102
    again = {r["flow_id"]: r["score"] for r in lifecycle.load(store, "m").classify(rows, "flow_id").collect()}
    assert again == {r["flow_id"]: r["score"] for r in made.classify(rows, "flow_id").collect()}
    assert store.evaluations().where("is_aggregated = 1").first()["decision_engine"] == engine and store.model_info("m")["model"]["transformers"] == ",".join(steps)
    info = store.read("classification_info").first()
    assert 0 < info["packet_read_time"] < info["total_time"]
    listed = reporting.listed_evaluations(store.evaluations()).first()
    assert listed["part_name"] == "all" and len(listed["decision_engine"]) <= 12
    report = reporting.evaluations_by_model(store.read("evaluations"), store.read("classification_info"), store.read("model").drop("dataset_name"))
    reporting.write_report(reporting.report(report, ["params"]), f"{tmp_path}/report.csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/report.csv").count() == 1
    ranked = reporting.ranked_report(report).first()
    assert ranked["group"] == "*_all" and set(ranked["metrics"]) == set(reporting.RANKED)
    reporting.write_json(ranked_rows := reporting.ranked_report(report), f"{tmp_path}/ranked")
    with pytest.raises(Exception, match="exist"):
        reporting.write_json(ranked_rows, f"{tmp_path}/ranked")
    assert lifecycle.run_totals(store.read("classification_info"), ["model_id"]).first()["packet_count"] == 102
    with pytest.raises(ValueError):
        lifecycle.classify(store, "c", "m", rows, packets)
    with pytest.raises(ValueError):
        lifecycle.train(store, "m", rows, engine, steps, params)


def test_training_needs_benign_flows(spark, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}")
    with pytest.raises(ValueError):
        lifecycle.train(store, "m", flows_of(spark, False, 1, 0).limit(0), "isolation_forest")


def test_transformers_of_named_features(spark):
    rows = spark.createDataFrame([(i, [float(i), float(i % 3), 1.0, float(-i)]) for i in range(30)], "flow_id long, features array<double>")
    names = ["fwd_max_pkt_length", "protocol", "other", "bwd_n_packets"]
    hot = lifecycle.TRANSFORMERS["onehot_encoder"](rows, "features", names)
    assert hot.names(names) == ["fwd_max_pkt_length", "other", "bwd_n_packets", "protocol_ohe_0.0", "protocol_ohe_1.0", "protocol_ohe_2.0"]
    unseen = spark.createDataFrame([([1.0, 9.0, 1.0, 2.0],)], "features array<double>")
    assert unseen.select(hot.column(F.col("features"))).first()[0] == [1.0, 1.0, 2.0, 0.0, 0.0, 0.0]
    keep = lifecycle.TRANSFORMERS["fixed_feature_name_filter"](rows, "features", names)
    assert keep.names(names) == ["fwd_max_pkt_length", "bwd_n_packets"]
    for step in (hot, keep, transformers.standard_scaler(rows), transformers.pca(rows, 2)):
        assert transformers.step_of(json.loads(json.dumps(transformers.step_state(step)))) == step
    with pytest.raises(ValueError):
        transformers.fixed_filter(names, ["a", "a"])


def test_options_of_the_engines():
    rng = np.random.default_rng(2)
    x, far = rng.normal(0, 1, (200, 5)), np.full((2, 5), 9.0)
    for metric in engines.METRICS:
        sets = metric in ("jaccard", "dice", "kulsinski", "rogerstanimoto", "russellrao", "sokalmichener", "sokalsneath", "yule", "hamming")
        rows = (x > 0).astype(float) if sets else x
        lof = engines.LocalOutlierFactor.fit(rows, 10, metric=metric)
        assert np.isfinite(lof(rows)).all()
        if not sets and metric not in ("cosine", "correlation", "canberra", "braycurtis"):
            assert (lof(far) > 1.5).all(), metric
    with pytest.raises(ValueError):
        engines.distance_block(x, x, "none")
    for activation in engines._ACTIVATIONS:
        auto = engines.Autoencoder(x, epochs=3, activation=activation, dropout=0.1, batch_norm=True)
        same = engines.Autoencoder.restored(*auto.state())
        assert np.isfinite(auto(x)).all() and np.array_equal(auto(x), same(x))
    patient = engines.Autoencoder(x, epochs=400, patience=2, rate=0.02)
    assert len(patient.history) < 400
    with pytest.warns(UserWarning):
        assert not engines.OneClassSvm(x, nu=0.2, gamma=0.1, max_iter=1).converged
    small, large = engines.OneClassSvm(x, nu=0.2, gamma=0.1, cache_mb=0.001), engines.OneClassSvm(x, nu=0.2, gamma=0.1)
    assert np.allclose(small(x), large(x))


def test_gradients_of_a_layer_stack():
    rng = np.random.default_rng(0)
    auto = engines.Autoencoder(rng.normal(size=(8, 3)), epochs=0, activation="softmax", batch_norm=True)
    x = rng.normal(size=(8, 3))
    loss = lambda: float(((auto._run(x, rng) - x) ** 2).sum())
    grad = 2 * (auto._run(x, rng) - x)
    for layer in reversed(auto.net):
        grad = layer.backward(grad)
    for layer in auto.net:
        for k, g in layer.grads.items():
            at = tuple(0 for _ in g.shape)
            layer.params[k][at] += 1e-6
            up = loss()
            layer.params[k][at] -= 2e-6
            down = loss()
            layer.params[k][at] += 1e-6
            assert (up - down) / 2e-6 == pytest.approx(g[at], rel=1e-3, abs=1e-5)


def _packets(spark, n: int, far: bool, name: str):
    """Pairs of hosts that talk; attackers send large packets fast."""
    rng = np.random.default_rng(n)
    rows = []
    for i in range(n):
        for k in range(4):
            size = int(rng.integers(900, 1400) if far else rng.integers(30, 90))
            rows.append((name, 4 * i + k, i * 40_000_000 + k * (1000 if far else 400_000), 100_000 + i, 200_000, 1000 + i, 80, 17, 64, size + 20, size, None, None, bytes([i % 250] * 8)))
    return spark.createDataFrame(rows, "file string, pkt_idx long, ts_us long, src_ip long, dst_ip long, src_port int, dst_port int, protocol int, ttl int, ip_len int, l4_len int, tcp_flags int, tcp_win int, payload binary")


def test_search_over_a_grid(spark, tmp_path):
    spec = {
        "decision_engine": {"name": "isolation_forest", "parameters": {"--n-estimators": [20], "--max-samples": [64]}},
        "feature_extractor": {"name": "payl_flows", "parameters": {"--nf-mode": [["subflows"], None], "--flow-timeout": [12]}},
        "transformers": [["minmax_scaler"], ["onehot_encoder", "standard_scaler"]],
    }
    (tmp_path / "grid.json").write_text(json.dumps(spec))
    grid = tuning.read_grid(f"{tmp_path}/grid.json")
    trials = tuning.trials(grid)
    assert [(t.index, sorted(t.settings.modes), t.transformers[-1]) for t in trials] == [(0, ["subflows"], "minmax_scaler"), (1, ["subflows"], "standard_scaler"), (2, [], "minmax_scaler"), (3, [], "standard_scaler")]
    store = ResultStore(spark, f"file://{tmp_path}/store")
    tests = _packets(spark, 20, False, "good").unionAll(_packets(spark, 8, True, "bad")).withColumn("record_id", F.concat_ws("-", "file", "pkt_idx"))
    truth = tests.select("record_id", (F.col("file") == "bad").cast("int").alias("truth"), F.lit("t").alias("traffic_name"), F.lit("all").alias("part_name"))
    done = tuning.search(store, grid, lambda: (_packets(spark, 60, False, "train"), tests, truth), only_index=0)
    assert len(done) == 1 and store.read("extracted_features").count() == 2
    total = store.evaluations().where("is_aggregated = 1").first()
    assert total["recall"] > 0.9 and total["support"] == 112
    assert store.model_info(done[0])["payl_flows"]["subflows"] is True
    assert store.migrate(1) == ["classification_info.is_finished", "classification_info.packet_count", "classification_info.packet_read_time", "classification_info.total_time", "evaluations.is_aggregated", "evaluations.dataset_name", "model.train_set_name", "model.dataset_name"]
    with pytest.raises(ValueError):
        store.migrate(3)
    old = ResultStore(spark, f"file://{tmp_path}/old")
    spark.createDataFrame([("c", "m")], "classification_id string, model_id string").write.parquet(f"{tmp_path}/old/classification_info")
    assert old.read("classification_info").first()["is_finished"] == -1
    for bad in ({"--nf-mode": ["x"]}, {"--flow-timeout": 1}):
        broken = spec | {"feature_extractor": {"name": "flow_extractor", "parameters": bad}}
        (tmp_path / "bad.json").write_text(json.dumps(broken))
        with pytest.raises(ValueError):
            tuning.trials(tuning.read_grid(f"{tmp_path}/bad.json"))
    (tmp_path / "bad.json").write_text("{pure")
    with pytest.raises(ValueError):
        tuning.read_grid(f"{tmp_path}/bad.json")
    assert tuning._engine_params("autoencoder", {"--threshold": 99, "--batch-normalization": "after_activation", "--early-stopping-patience": 3}) == ({"batch_norm": True, "patience": 3}, 0.99)


def test_appends_are_whole_or_nothing(spark, tmp_path):
    store = ResultStore(spark, f"file://{tmp_path}")
    kind = "classification_id string, record_id string, label int"
    row = lambda *ids: spark.createDataFrame([("c", i, 0) for i in ids], kind)
    store.append("classification_results", row("a", "b"))
    with pytest.raises(ValueError, match="already has"):
        store.append("classification_results", row("b", "d"))
    with pytest.raises(Exception, match="divide by zero|DIVIDE_BY_ZERO"):
        store.append("classification_results", row("e").withColumn("label", F.expr("cast(1 / (label * 1) as int)")))
    folder = tmp_path / "classification_results"
    (folder / "_staging-lost").mkdir()
    row("f").write.parquet(f"file://{folder}/_staging-lost/x")
    assert sorted(r["record_id"] for r in store.read("classification_results").collect()) == ["a", "b"]
    assert sorted(p.name for p in folder.iterdir() if p.name.startswith("commit")) == ["commit-00000000"]
    (folder / "_claim-00000001").touch()  # a writer that is gone
    store.append("classification_results", row("g"), patience=0.5)
    assert sorted(p.name for p in folder.iterdir() if p.name.startswith("commit")) == ["commit-00000000", "commit-00000002"]
    assert store.read("classification_results").count() == 3


def test_of_two_writers_of_one_key_one_fails(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = ResultStore(spark, f"file://{tmp_path}")

    def write(k):
        try:
            store.append("classification_results", spark.createDataFrame([("c", "same", 0), ("c", f"own{k}", 0)], "classification_id string, record_id string, label int"))
            return True
        except ValueError:
            return False

    with ThreadPoolExecutor(3) as pool:
        assert sorted(pool.map(write, range(3))) == [False, False, True]
    assert store.read("classification_results").count() == 2
