"""Captures read in ranges by many tasks against the one-task reader."""

from __future__ import annotations

import io
import random
import struct

import pytest
from pyspark.sql import functions as F

from flowsift.sources import pcap
from tests.captures import ethernet, ip_packet, pcap_file


def _frames(r: random.Random, n: int) -> list[tuple[int, bytes]]:
    """Packets of many lengths; some hold zeros, some a capture of their own."""
    inner = pcap_file([(k, b"x" * 9) for k in range(1, 60)])
    out = []
    for k in range(n):
        data = r.choice([b"", r.randbytes(r.randrange(40)), b"\0" * 900, inner[r.randrange(24) :], r.randbytes(3000)])
        out.append((1_600_000_000_000_000 + k * 1000, ethernet(ip_packet("10.0.0.1", f"10.0.{k % 250}.9", 1000 + k % 7, 80, r.choice([6, 17]), data=data))))
    return out


def _block(end: str, kind: int, body: bytes) -> bytes:
    body += b"\0" * (-len(body) % 4)
    return struct.pack(end + "II", kind, 12 + len(body)) + body + struct.pack(end + "I", 12 + len(body))


def _pcapng(r: random.Random, frames: list[tuple[int, bytes]]) -> bytes:
    """Sections of both byte orders, interfaces that come late, with other ticks and a time offset, and packets of all three kinds."""
    out, end, n_links = b"", "<", 0
    for k, (t, f) in enumerate(frames):
        if k % 37 == 0:
            end, n_links = r.choice("<>"), 0
            out += _block(end, 0x0A0D0D0A, struct.pack(end + "IHHq", 0x1A2B3C4D, 1, 0, -1))
        if not n_links or r.random() < 0.05:
            options = struct.pack(end + "HHBxxx", 9, 1, 9) + struct.pack(end + "HHq", 14, 8, 1000) if n_links else b""
            out += _block(end, 1, struct.pack(end + "HHI", 1, 0, 2000 if not n_links else 0) + options + b"\0" * 4 * bool(options))
            n_links += 1
        which = r.randrange(n_links)
        ticks = t if not which else (t - 1_000_000_000) * 1000
        if r.random() < 0.1:
            out += _block(end, 5, r.randbytes(16))  # statistics
        kind = r.choice([2, 3, 6, 6])
        if kind == 3:
            out += _block(end, 3, struct.pack(end + "I", len(f)) + f[:2000])
        else:
            head = struct.pack(end + "I", which) if kind == 6 else struct.pack(end + "HH", which, 5)
            out += _block(end, kind, head + struct.pack(end + "IIII", ticks >> 32, ticks & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


def _plain(spark, path: str):
    spark.dataSource.register(pcap.PcapSource)
    return sorted(map(tuple, spark.read.format("pcap").load(path).collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("split", [12_000])
def test_ranges_against_one_task(spark, tmp_path, split):
    r = random.Random(split)
    frames = _frames(r, 150)
    (tmp_path / "a.pcap").write_bytes(pcap_file(frames))
    (tmp_path / "b.pcapng").write_bytes(_pcapng(r, frames))
    (tmp_path / "c d.cap").write_bytes(pcap_file(frames[:3]))
    (tmp_path / "empty.pcap").write_bytes(b"")
    (tmp_path / "head.pcap").write_bytes(pcap_file([]))
    (tmp_path / "other.txt").write_bytes(b"no capture")
    rows = pcap.read_pcap(spark, str(tmp_path), split).withColumn("task", F.spark_partition_id())
    got = sorted(map(tuple, rows.drop("task").collect()), key=lambda x: x[:2])
    (tmp_path / "empty.pcap").unlink()
    want = _plain(spark, str(tmp_path))
    assert got == want and len(got) == 303
    assert [x[1] for x in got if x[0] == "b.pcapng"] == list(range(150))
    tasks = {x["file"]: x["n"] for x in rows.groupBy("file").agg(F.countDistinct("task").alias("n")).collect()}
    assert tasks["a.pcap"] > 5 and tasks["b.pcapng"] > 5 and tasks["c d.cap"] == 1
    one = pcap.read_pcap(spark, str(tmp_path / "a.pcap"), split)
    assert one.count() == 150 and one.agg(F.countDistinct("pkt_idx"), F.max("pkt_idx")).first()[:] == (150, 149)


def test_all_kinds_of_pcapng_packets():
    r = random.Random(1)
    frames = _frames(r, 200)
    got = list(pcap.frames(io.BytesIO(_pcapng(r, frames))))
    assert len(got) == 200
    assert all(ts in (None, t) and f == g[: len(f)] and (len(f) == len(g) or ts is None) for (ts, _, f), (t, g) in zip(got, frames))
    assert any(ts is None for ts, _, _ in got)


def test_guesses_that_are_wrong_are_set_right(spark, tmp_path):
    """Every packet holds a long capture, so that most ranges begin inside one."""
    inner = pcap_file([(k, b"y" * 30) for k in range(1, 150)])[24:]
    frames = [(k * 10, ethernet(ip_packet("10.0.0.1", "10.0.0.2", 5, 6, 17, data=inner))) for k in range(1, 12)]
    (tmp_path / "a.pcap").write_bytes(pcap_file(frames))
    assert sorted(map(tuple, pcap.read_pcap(spark, str(tmp_path), 4096).collect()), key=lambda x: x[1]) == _plain(spark, str(tmp_path))


def test_cut_captures_in_ranges(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap_file(_frames(random.Random(2), 100))[:-3])
    with pytest.raises(Exception, match="ends inside"):
        pcap.read_pcap(spark, str(tmp_path), 20_000).count()
    assert pcap.read_pcap(spark, str(tmp_path), 20_000, truncated="stop").count() == 99
    with pytest.raises(ValueError):
        pcap.read_pcap(spark, str(tmp_path), 10)
