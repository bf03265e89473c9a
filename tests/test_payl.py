"""Sums of payloads by tasks against plain centroids and distances."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift.operators import payl
from flowsift.plans import catalogue


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(4)
    made = [(i, "t" if i % 3 else None, int(r.integers(3)), int(r.integers(7)), None if i % 50 == 0 else r.integers(0, 200 if i % 7 else 3, int(r.integers(40))).astype(np.uint8).tobytes()) for i in range(2400)]
    made.append((2400, "t", 1, 1, bytes(range(256)) * 9000))
    return spark.createDataFrame([(*m[:4], bytearray(m[4]) if m[4] is not None else None) for m in made], "id long, protocol string, port int, length long, payload binary").repartition(5, "id")


@pytest.mark.parametrize("held", [5, 4096])
def test_centroids_of_payloads(rows, monkeypatch, held):
    monkeypatch.setattr(payl, "HELD_KEYS", held)
    plain = payl.centroids(payl.byte_shares(rows, "payload", payl.KEY))
    want = {tuple(r[c] for c in payl.KEY): r for r in plain.collect()}
    got = payl.payload_centroids(rows).collect()
    assert len(got) == len(want) and {r["n"] for r in got} == {r["n"] for r in want.values()}
    for r in got:
        one = want[tuple(r[c] for c in payl.KEY)]
        assert r["n"] == one["n"] and all(np.allclose(r[c], one[c], atol=1e-12) for c in ("mean", "squares", "std"))
    assert payl.payload_centroids(rows.where(F.lit(False))).collect() == []


@pytest.mark.parametrize("paper", [True, False])
def test_distances_of_payloads_in_parts(rows, monkeypatch, paper):
    monkeypatch.setattr(payl, "PART_ROWS", 30)
    table = payl.payload_centroids(rows).where("length != 3 AND port != 2")
    freq = payl.byte_shares(rows, "payload", ["id", *payl.KEY])
    want = {r["id"]: r["distance"] for r in payl.distances(freq, table, ["id"], 0.1, paper).collect()}
    got = payl.payload_distances(rows, table, ["id"], "payload", 0.1, paper).collect()
    assert len(got) == len(want) == 2401 and all(r["distance"] == pytest.approx(want[r["id"]], abs=1e-9) for r in got)
    assert -1 in {r["distance"] for r in got}


def test_captured_packets_are_read_once(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(20)
    events.union(events.where("event_id < 3")).write.parquet(f"{tmp_path}/events.parquet")
    assert catalogue.captured(spark, tmp_path).count() == events.count() + events.where("event_id < 3").count()
