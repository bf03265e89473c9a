"""The table function against the extractor of DataFrames."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from flowsift.operators import extractors, flow_table
from flowsift.operators.extractors import FlowSettings

KIND = "file string, pkt_idx long, ts_us long, src_ip long, dst_ip long, src_port int, dst_port int, protocol int, ttl int, ip_len long, l4_len long, tcp_flags int, tcp_win int, payload binary"


@pytest.fixture(scope="module")
def frame(spark):
    """Two sequences of packets with one very busy key, equal addresses, packets without ports and such without addresses."""
    r, rows = random.Random(5), []
    for file in ("a", "b"):
        at = 0
        for i in range(700):
            at += r.choice([0, 1000, 50_000, 700_000, 9_000_000, 13_000_000])
            a, b = r.choice([(1, 2), (2, 1), (1, 2), (2, 1), (1, 3), (3, 1), (2, 2), (None, None)])
            proto = r.choice([6, 6, 17, 1]) if a else None
            ports = (None, None) if proto in (1, None) else (10 * a, 10 * b) if a != b else r.choice([(5, 6), (6, 5)])
            size = r.randint(28, 1500)
            tcp = (r.choice([2, 18, 16, 17, 4, 24, 32]), r.randint(0, 900)) if proto == 6 else (None, None)
            rows.append((file, i, at, a, b, *ports, proto, r.randint(1, 64) if a else None, size, size - 20, *tcp, b"x"))
    flow_table.register(spark)
    return spark.createDataFrame(rows, KIND)


@pytest.mark.parametrize("modes", ["", "basic", "basic tcp", "tcp subflows with_ip_addr", "tcp tcp_end_on_rst include_header_length", "subflows"])
@pytest.mark.parametrize("options", [{}, {"first_only": True}, {"timeout_and_fin": True}])
def test_equals_the_extractor(spark, frame, modes, options):
    named = "".join(f", {k} => true" for k in options)
    got = spark.sql(f"SELECT * FROM flow_features(TABLE({{p}}), modes => '{modes}', timeout => 12.0, subflow => 0.5{named})", p=frame)
    want = extractors.flow_features(frame, FlowSettings(frozenset(modes.split()), **options)).drop("flow_idx")
    assert got.columns == want.columns and [t for _, t in got.dtypes] == [t for _, t in want.dtypes]
    mine, theirs = ({(r["file"], r["flow_first"]): r for r in d.collect()} for d in (got, want))
    assert mine.keys() == theirs.keys() and len(mine) > 50
    for k, row in theirs.items():
        assert tuple(mine[k])[1:] == pytest.approx(tuple(row)[1:], abs=1e-9), k


def test_odd_tables(spark, frame):
    call = "SELECT * FROM flow_features(TABLE({p}), modes => 'tcp subflows')"
    assert spark.sql(call, p=frame.limit(0)).collect() == []
    assert spark.sql(call, p=frame.where("src_ip IS NULL")).collect() == []
    bare = frame.withColumns({c: F.lit(None).cast(t) for c, t in (("l4_len", "long"), ("ttl", "int"))}).withColumn("n_packets", F.lit(1))
    want = extractors.flow_features(bare, FlowSettings(frozenset({"tcp", "subflows"}))).drop("flow_idx").orderBy("file", "flow_first").collect()
    got = spark.sql(call, p=bare).orderBy("file", "flow_first").collect()
    assert len(got) == len(want) and all(tuple(g)[1:] == pytest.approx(tuple(w)[1:], abs=1e-9) for g, w in zip(got, want))


def test_unusual_names_of_sequences(spark, frame):
    named = frame.withColumnsRenamed({"file": "my file`s"})
    with pytest.raises(Exception, match="packets lack"):
        spark.sql("SELECT * FROM flow_features(TABLE({p}))", p=named).collect()
    other = frame.withColumn("traffic_name", F.col("file"))
    assert spark.sql("SELECT * FROM flow_features(TABLE({p}), by => 'file traffic_name')", p=other).count() == spark.sql("SELECT * FROM flow_features(TABLE({p}))", p=frame).count()


@pytest.mark.parametrize("arguments, why", [("modes => 'hindsight'", "has no mode"), ("modes => 'none'", "unknown modes"), ("modes => 'basic subflows'", "no other mode"), ("timeout => NULL", "must be constants")])
def test_settings_are_checked_before_anything_runs(spark, frame, arguments, why):
    with pytest.raises(Exception, match=why):
        spark.sql(f"SELECT * FROM flow_features(TABLE({{p}}), {arguments})", p=frame)


def test_spread_of_numbers_seen_once():
    s = flow_table.Spread()
    assert s.values(-1)["std"] == -1
    for v in (1e9 + 4, 1e9 + 7, 1e9 + 13, 1e9 + 16):
        s.add(v)
    assert s.values(-1) == {"sum": 4e9 + 40, "mean": 1e9 + 10, "min": 1e9 + 4, "max": 1e9 + 16, "std": pytest.approx(22.5**0.5)}


def test_query_reads_the_function_once(spark, monkeypatch):
    from flowsift.plans import catalogue

    stored = []
    monkeypatch.setattr(catalogue, "written", lambda df, name: stored.append(name) or df)
    plan = catalogue.QUERIES["q_flow_features_sql"](spark, "/root/testdata/sf0.001")
    assert stored == ["flows"] and "flow_features" not in catalogue.FLOW_FEATURES_SQL and plan.columns[:2] == ["file", "flow_first"]
