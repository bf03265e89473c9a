"""Fixtures of the network operators: metrics, label join, flow ids, sessions, captures, engines."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift.functions import columns as C
from flowsift.operators import engines, evaluation, flows, labels, neighbours, payl, transformers
from flowsift.plans import catalogue
from tests.oracle import assert_same, connection

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    assert_same(catalogue.QUERIES[name](spark, SMALL), con, catalogue.ORACLE_SQL[name])


def test_metric_vector(spark):
    row = evaluation.with_metrics(spark.createDataFrame([(123, 987, 2412, 1343)], "tp long, fp long, tn long, fn long")).first()
    want = {"accuracy": 0.5211, "positives": 1466, "negatives": 3399, "precision": 0.1108, "recall": 0.0839, "tnr": 0.7096, "npv": 0.6423, "fpr": 0.2904, "fdr": 0.8892, "fnr": 0.9161, "f1_score": 0.0955, "support": 4865, "kappa": -0.2218, "mcc": -0.2258}
    assert {k: round(row[k], 4) for k in want} == want


@pytest.mark.parametrize("use_end", [True, False])
def test_interval_matcher(spark, use_end):
    table = [("A", 2300, 4000, 1), ("B", 4001, 4100, 0), ("C", 7000, 8100, 1), ("D", 9300, 9900, 1), ("E", 10010, 20000, 0), ("F", 23000, 30000, 1)]
    known = spark.createDataFrame([("k", s, e, t, n, i) for i, (n, s, e, t) in enumerate(table)], "key string, start_us long, end_us long, traffic_type int, info string, seq int")
    inside = {2300: "A", 4000: "A", 4001: "B", 4100: "B", 7000: "C", 8000: "C", 9900: "D", 10500: "E", 23000: "F", 30000: "F"}
    outside = {40: None, 4101: "B", 10000: "D", 30001: "F", 40000: "F"}
    want = inside | ({t: None for t in outside} if use_end else outside)
    got = labels.asof_labels(spark.createDataFrame([(i, t, "k") for i, t in enumerate(want)], "pkt_idx int, ts_us long, key string"), known, "key", use_end)
    kinds = {n: t for n, _, _, t in table}
    assert {r["ts_us"]: (r["matched"], r["traffic_type"]) for r in got.collect()} == {t: (n is not None, kinds.get(n, 0)) for t, n in want.items()}


def test_expired_flow_gives_way_to_an_open_one(spark):
    known = spark.createDataFrame([("k", 1000, 2000, 1, "a", 0), ("k", 1200, 1300, 1, "b", 1)], "key string, start_us long, end_us long, traffic_type int, info string, seq int")
    got = labels.asof_labels(spark.createDataFrame([(0, 1500, "k")], "pkt_idx int, ts_us long, key string"), known, "key", True)
    assert got.first()["attack_type"] == "a"


def test_reverse_ids(spark):
    rows = spark.createDataFrame([("20.1.20.1-172.168.1.1-443-80-7",), ("0-0-0-0-0",), ("A-B-B-A-1-2-0",)], "id string").select(C.reverse_flow_id(F.col("id")))
    assert [r[0] for r in rows.collect()] == ["172.168.1.1-20.1.20.1-80-443-7", "0-0-0-0-0", "<invalid flow>"]


def test_sessions_against_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 300)), int(rng.integers(3)), bool(rng.integers(5) == 0), bool(rng.integers(2))) for i in range(400)]
    got = flows.sessionize(spark.createDataFrame(rows, "pkt_idx int, ts_us long, k int, fin boolean, tcp boolean"), ["k"], 40, F.col("fin"), F.col("tcp"))
    seq, last, want = {}, {}, {}
    for i, ts, k, fin, tcp in rows:
        new = k not in seq or (fin if tcp else ts - last[k] > 40)
        seq[k], last[k] = seq.get(k, 0) + new, ts
        want[i] = seq[k]
    assert {r["pkt_idx"]: r["flow_seq"] for r in got.collect()} == want


def test_centroid_of_equal_payloads(spark):
    freq = [0.25, 0.1, 0.1, 0.5, 0.05] + [0.0] * 251
    row = payl.centroids(spark.createDataFrame([("t", "p", 10, freq)] * 100, "protocol string, port string, length int, freq array<double>")).first()
    assert np.allclose(row["mean"], freq) and np.allclose(row["std"], 0, atol=1e-7) and row["n"] == 100


def test_engines_tell_outliers():
    rng = np.random.default_rng(0)
    x, far = rng.normal(0, 1, (300, 4)), np.full((3, 4), 9.0)
    lof = engines.LocalOutlierFactor.fit(x)
    assert (lof(far) > 1.5).all() and (lof(x) < 1.5).mean() > 0.9
    forest = engines.IsolationForest(x, seed=1)
    assert forest(far).min() > np.quantile(forest(x), 0.95)
    svm = engines.OneClassSvm(x, nu=0.1, gamma=0.1)
    assert (svm(far) < 0).all() and (svm(x) < 0).mean() <= 0.2
    auto = engines.Autoencoder(x, epochs=8)
    assert auto.history[-1] < auto.history[0] and auto(far).min() > np.quantile(auto(x), 0.95)
    assert engines.layer_sizes("*0.7,*0.8,#1", 10) == [7, 6, 7]


def test_scaler_of_a_constant(spark):
    rows = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "features array<double>")
    assert [r[0] for r in rows.select(transformers.standard_scaler(rows).column(F.col("features"))).collect()] == [[-1.0, 0.0], [1.0, 0.0]]
    assert [r[0] for r in rows.select(transformers.minmax_scaler(rows).column(F.col("features"))).collect()] == [[0.0, 0.0], [1.0, 0.0]]


def test_engines_take_all_rows(spark, tmp_path):
    x = np.random.default_rng(3).normal(size=(2300, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    want = engines.LocalOutlierFactor.fit(x)(x)
    got = {r["vec_id"]: r["score"] for r in catalogue.QUERIES["q_lof"](spark, str(tmp_path)).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want, rtol=1e-5)
    blocked = {(r["query_id"], r["rank"]): r["point_id"] for r in neighbours.neighbours(rows, "vec_id", "embedding", 3, block=500).collect()}
    _, at = engines._near(x, x, 3, 2, True)
    assert blocked == {(i, k + 1): int(at[i, k]) for i in range(len(x)) for k in range(3)}
    # the trees draw from all rows: one far row of 300 is met by most of 100 trees of 256 rows
    far = spark.createDataFrame([(i, [0.0, 9.0 if i == 7 else i / 300]) for i in range(300)], "vec_id long, embedding array<double>")
    forest = engines.isolation_forest(far, "vec_id", "embedding")
    score = forest(np.array([[0.0, 9.0], [0.0, 0.5]]))
    assert forest.size == 256 and len(forest.trees) == 100 and score[0] > score[1]


def test_protocol_numbers(spark):
    # fixed values: names of labelled flows that system tables lack or number otherwise
    named = {"nvp": 11, "sep": 33, "ospf": 89, "swipe": 53, "ipnip": 4, "argus": 13, "bbn-rcc": 10, "st2": 5, "dcn": 19, "mhrp": 48, "ipv6-no": 59, "micp": 95, "aes-sp3-d": 96, "ipx-n-ip": 111, "sm": 122, "unas": 144}
    none = ["ip", "any", "isis", "sccopmce", "pri-enc", "zero", "ib", "arp", "udt", "rtp"]
    assert {n: C.PROTOCOLS.get(n) for n in named} == named and not set(none) & set(C.PROTOCOLS)
    rest = {"tcp": 6, "udp": 17, "icmp": 1, "igmp": 2, "ggp": 3, "egp": 8, "gre": 47, "esp": 50, "ah": 51, "ipip": 94, "ipcomp": 108, "sps": 130, "sctp": 132, "l2tp": 115, "ipv6-frag": 44, "hip": 139}
    rows = [(f" {n.upper()}", v) for n, v in (named | rest).items()] + [(n, None) for n in [*none, None]]
    df = spark.createDataFrame(rows, "name string, want int")
    assert df.where(~C.protocol_number(F.col("name")).eqNullSafe(F.col("want"))).collect() == []


def test_hindsight_of_a_hot_address(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "hot" if rng.random() < 0.6 else f"a{rng.integers(9)}", int(rng.integers(3))) for i in range(700)]
    flow = spark.createDataFrame(rows, "flow_idx long, addr string, port int").repartition(3)
    for previous, width in ((100, 128), (7, 64), (100, 1)):
        got = {r["flow_idx"]: (r["hindsight_a"], r["hindsight_ap"]) for r in flows.hindsight_counts(flow, {"a": ["addr"], "ap": ["addr", "port"]}, previous, width).collect()}
        want = {i: (sum(o[1] == a for o in rows[max(0, i - previous) : i]), sum(o[1:] == (a, p) for o in rows[max(0, i - previous) : i])) for i, a, p in rows}
        assert got == want


@pytest.mark.parametrize("mode", ["timeout", "fin", "both"])
def test_sessions_of_a_hot_key_by_ranges(spark, mode):
    rng = np.random.default_rng(7)
    at = np.cumsum(rng.integers(0, 9_000_000, 900) + (rng.random(900) < 0.03) * 40_000_000)
    rows = [(i, int(t), "hot" if rng.random() < 0.7 else None if rng.random() < 0.1 else f"k{rng.integers(6)}", bool(rng.random() < 0.1), bool(rng.random() < 0.8)) for i, t in enumerate(at)]
    packets = spark.createDataFrame(rows, "pkt_idx long, ts_us long, host string, fin boolean, tcp boolean").repartition(3)
    options = {} if mode == "timeout" else {"fin": F.col("fin"), "is_tcp": F.col("tcp"), "timeout_and_fin": mode == "both"}
    want = flows.sessionize(packets, ["host"], 12_000_000, **options)
    for width in (1, 40, 10_000):
        got = flows.sessionize(packets, ["host"], 12_000_000, **options, width=width)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
