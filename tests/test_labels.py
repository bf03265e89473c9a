"""Association of packets with labelled flows by id and reverse id, in all settings, and the files and data sets around it."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from flowsift.functions import columns as C
from flowsift.operators import labels
from flowsift.plans import preprocess
from flowsift.sources import datasets, packet_labels
from tests.captures import cooked, ip_packet, pcap_file

#: Labelled flows (id, start, end, info, type, packets of source and of destination) and packets of the association fixture.
FLOWS = [
    ("1-80-2-443", 1000, 1999.99, "Attack A", 1, 4, 33),
    ("1-80-2-443", 2000, 2900, "", 0, 20, 4),
    ("2-443-1-80", 4000, 5100, "Attack B", 1, 20, 4),
    ("2-443-3-9000", 1000, 3800, "Attack A", 1, 20, 4),
    ("3-9000-2-443", 4000, 4900, "", 0, 4, 4),
    ("2-443-3-9000", 6000, 6950, "Attack B", 1, 44, 222),
    ("4-1111-2-443", 1000, 1500, "Attack C", 1, 3, 2),
    ("2-443-4-1111", 3000, 3002, "Attack E", 1, 22, 33),
    ("4-1111-2-443", 5000, 6000, "", 0, 222, 3),
    ("2-443-1-80", 3000, 3100, "Attack C", 1, 44, 22),
    ("5-5151-2-443", 1000, 2900, "", 0, 2, 2),
    ("6-666-5-443", 2000, 2900, "Attack Z", 1, 44, 44),
    ("5-443-6-666", 3000, 3900, "", 0, 3, 2),
    ("4-333-5-333", 2000, 100000, "Attack Uni", 1, 2, 0),
]
PACKETS = {
    "Attack A": [(1000, "1-80-2-443"), (1010, "1-80-2-443"), (1020, "1-80-2-443"), (1040, "1-80-2-443"), (1050, "1-80-2-443"), (1999.99, "1-80-2-443"), (1051, "2-443-1-80"), (1052, "2-443-1-80"), (3109.2321323, "3-9000-2-443")],
    "Attack B": [(5033, "2-443-1-80"), (5030, "1-80-2-443")],
    "Attack C": [(3030, "1-80-2-443"), (1200, "2-443-4-1111"), (1500, "4-1111-2-443")],
    "Attack E": [(3002, "4-1111-2-443")],
    "Attack Z": [(2020, "5-443-6-666"), (2090, "5-443-6-666"), (2091, "6-666-5-443")],
    "Attack Uni": [(2000, "4-333-5-333"), (2100, "4-333-5-333"), (99900, "5-333-4-333")],
    None: [(2000, "2-443-1-80"), (2002, "1-80-2-443"), (6000, "2-443-5-5151"), (6100, "2-443-5-5151"), (6900, "2-443-5-5151"), (6400, "5-5151-2-443"), (6500, "5-5151-2-443"), (5900, "2-443-4-1111"), (3001, "6-666-5-443"), (3055, "5-443-6-666"), (3056, "5-443-6-666"), (100, "1-80-2-443"), (200, "6-666-5-443"), (9999, None)],
}


def _mirrored(ident: str | None) -> str | None:
    p = ident.split("-") if ident else None
    return "-".join([*p[2:], *p[:2]]) if p else None


def _fixture(spark):
    flows = [(i, "2-433-3-9000" if i == "3-9000-2-443" else _mirrored(i), int(s * 1e6), int(e * 1e6), info, t, i.split("-")[0], int(i.split("-")[1]), a, b) for i, s, e, info, t, a, b in FLOWS]
    packets = [(f"p{k}-{i}", int(t * 1e6), i, _mirrored(i), i.split("-")[0] if i else None, int(i.split("-")[1]) if i else None, kind) for kind, ps in PACKETS.items() for k, (t, i) in enumerate(ps)]
    packets = [(f"{n}", *p[1:]) for n, p in enumerate(packets)]
    return (
        spark.createDataFrame(flows, "flow_id string, reverse_id string, start_us long, end_us long, info string, traffic_type int, src_ip string, src_port int, src_packets int, dest_packets int"),
        spark.createDataFrame(packets, "packet_id string, ts_us long, flow_id string, reverse_id string, src_ip string, src_port int, want string"),
    )


@pytest.mark.parametrize("use_end", [False, True])
@pytest.mark.parametrize("one_way", [False, True])
@pytest.mark.parametrize("bucket_us", [labels.BUCKET, 700_000_000])
def test_association(spark, use_end, one_way, bucket_us):
    flows, packets = _fixture(spark)
    rows = labels.associate(packets, flows, use_end, one_way, bucket_us).collect()
    assert len(rows) == packets.count()
    for r in rows:
        want = None if r["ts_us"] == 99_900_000_000 and one_way else r["want"]
        assert (r["attack_type"], r["traffic_type"]) == (want, int(want is not None)), r
    told = {(r["ts_us"] // 1_000_000, r["diagnosis"]) for r in rows if r["diagnosis"]}
    assert told == {(9999, "no_flow_id"), (100, "no_flow"), (200, "no_flow")} | ({(99900, "no_flow")} if one_way else set())


def test_label_files_round_trip(spark, tmp_path):
    flows, packets = _fixture(spark)
    found = labels.associate(packets, flows).persist()
    packet_labels.write_packet_labels(found, f"{tmp_path}/labels.csv")
    back = {r["packet_id"]: r for r in packet_labels.read_packet_labels(spark, f"{tmp_path}/labels.csv").collect()}
    assert {k: (r["traffic_type"], r["attack_type"]) for k, r in back.items()} == {r["packet_id"]: (r["traffic_type"], r["attack_type"]) for r in found.collect()}
    assert sum(r["flow_id"] == "unknown" for r in back.values()) == 1
    (tmp_path / "short.csv").write_text("packet_id,timestamp,flow_id,reverse_flow_id,traffic_type,attack_type\na-0,1.5,x,y,0\na-1,2.5,x,y,1,dos\n")
    assert [tuple(r)[4:] for r in packet_labels.read_packet_labels(spark, f"{tmp_path}/short.csv").orderBy("packet_id").collect()] == [(0, None), (1, "dos")]
    with pytest.raises(FileNotFoundError):
        packet_labels.read_packet_labels(spark, f"{tmp_path}/none.csv").count()
    told = {r["diagnosis"]: (r["count"], len(r["first"])) for r in packet_labels.diagnostics(found, 1).collect()}
    assert told == {"no_flow_id": (1, 1), "no_flow": (3, 1)}
    stats = packet_labels.capture_stats(found.withColumn("pcap", F.lit("1")))
    packet_labels.write_stats(stats, f"{tmp_path}/stats.csv")
    assert sorted(map(tuple, packet_labels.long_stats(packet_labels.read_stats(spark, f"{tmp_path}/stats.csv")).collect())) == sorted(map(tuple, packet_labels.long_stats(stats).collect()))
    text = {r["statistic"]: r["1"] for r in labels.stats_text(stats, "pcap").collect()}
    assert text["total"] == str(len(back)) and text["fraction_attacks"].endswith("%")


def test_subsets():
    tiny = datasets.day_subset("tiny")
    assert tiny.train == {"PCAPs/Monday-WorkingHours.pcap": [(0, 100), (400, 1000)], "PCAPs/Thursday-WorkingHours.pcap": [(0, 400)]}
    assert list(datasets.day_subset("friday").test) == ["PCAPs/Friday-WorkingHours.pcap"] and len(datasets.day_subset().test) == 4
    some = datasets.numbered_subset("1-3,14/b")
    assert list(some.train) == ["01/1.pcap", "01/2.pcap", "01/3.pcap", "01/14.pcap"] and list(some.test)[0] == "02/1.pcap" and len(some.test) == 14
    assert (some.train_name, some.test_name) == ("1-3,14", "b")
    default = datasets.numbered_subset("default", ["01/1.pcap", "01/23.pcap"])
    assert list(default.train) == ["01/23.pcap"] and list(default.test) == ["01/1.pcap"]
    assert len(datasets.numbered_subset("A/c").train) == 22 and len(datasets.all_captures()) == 80
    for bad in ("x", "1-3/", "/b", "99/b", "monday"):
        with pytest.raises(ValueError):
            (datasets.day_subset if bad == "monday" else datasets.numbered_subset)(bad)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A small data set of numbered captures: five attack packets among the first twenty, flows in four files."""
    top = tmp_path_factory.mktemp("numbered")
    (top / "01").mkdir()
    frames = [(1_000_000_000 + i * 1_000_000, cooked(ip_packet("10.0.0.1", "10.0.0.2", 1000 + i % 3, 80, 17 if i % 4 else 6, data=bytes([i] * 9)))) for i in range(40)]
    (top / "01/1.pcap").write_bytes(pcap_file(frames, 113))
    csv = top / "UNSW-NB15 - CSV Files"
    csv.mkdir()
    names = ["srcip", "sport", "dstip", "dsport", "proto", "Spkts", "Dpkts", "Stime", "Ltime", "attack_cat", "Label"]
    (csv / "NUSW-NB15_features.csv").write_text("No.,Name\n" + "".join(f"{i},{n}\n" for i, n in enumerate(names)))
    for i in range(1, 5):
        attack = "10.0.0.1,1000,10.0.0.2,80,udp,9,0,1000,1040, Exploits ,1\n" if i == 1 else f"10.0.0.{i},7,10.0.0.2,80,odd{i},1,1,1000,1001,,0\n"
        (csv / f"UNSW-NB15_{i}.csv").write_text(attack + "10.0.0.1,1001,10.0.0.2,80,tcp,1,1,1000,1040,,0\n")
    return top


def test_preprocess_and_read(spark, folder):
    report = {r["attack_type"]: r for r in preprocess.preprocess(spark, "unsw-nb15", str(folder), ["01/1.pcap"]).collect()}
    want = sum(1 for i in range(40) if i % 3 == 0 and i % 4)
    assert (report["exploits"]["expected"], report["exploits"]["actual"], report["total"]["expected_flows"]) == (9, want, 1)
    traffic = datasets.read_traffic(spark, str(folder), datasets.numbered_subset("tiny"), training=False)
    assert traffic.packets.count() == 9 and traffic.labels.count() == 40
    parts = {r["part_name"]: r["n"] for r in traffic.parts.groupBy("part_name").agg(F.count("*").alias("n")).collect()}
    assert parts == {"all": 40, "exploits": 40}
    for drop in (False, True):
        train = datasets.read_traffic(spark, str(folder), datasets.numbered_subset("tiny"), training=True, drop_attacks=drop)
        assert train.packets.count() == (sum(1 for i in range(20) if not (i % 3 == 0 and i % 4)) if drop else 20)
    assert [json.loads(x)["diagnosis"] for x in spark.read.json(f"{folder}/preprocessing_report").toJSON().collect()] == []
    again = preprocess.preprocess(spark, "unsw-nb15", str(folder), ["01/1.pcap"], only_validate=True)
    assert again.count() == 2


def test_made_up_traffic(spark):
    assert datasets.dummy_traffic(spark, True).packets.count() == 3000
    found = datasets.dummy_traffic(spark, False).labels.groupBy("traffic_name").agg(F.count_if(F.col("traffic_type") == 0).alias("n")).orderBy("traffic_name").collect()
    assert [r["n"] for r in found] == [100 * i for i in range(10)]


def test_day_flows(spark):
    row = spark.createDataFrame([("1.2.3.4-5.6.7.8-10-80-6", "1.2.3.4", "10", "7/7/2017 3:30", "12", "0", "DDOS ")], "`Flow ID` string, `Source IP` string, `Source Port` string, Timestamp string, `Total Fwd Packets` string, `Total Backward Packets` string, Label string")
    got = datasets.day_flows(row, business_hours=True).first()
    assert (got["reverse_id"], got["traffic_type"], got["info"], got["dest_packets"]) == ("5.6.7.8-1.2.3.4-80-10-6", 1, "ddos", 0)
    assert got["start_us"] == 1499452200000000  # 15:30 Atlantic summer time


def test_helpers(spark):
    rows = spark.createDataFrame([("tcp", 1), (" ICMP", 1), ("odd", 0), (None, 0)], "proto string, traffic_type int")
    assert [tuple(r) for r in labels.unknown_protocols(rows).collect()] == [("odd", 1)]
    assert labels.without_protocols(rows, ["TCP"]).count() == 3
    attack, benign = labels.split_traffic(rows)
    assert (attack.count(), benign.count()) == (2, 2)
    with pytest.raises(ValueError):
        labels.require_columns(rows, ["proto", "missing"])
    assert labels.require_columns(rows, ["proto"]).columns == ["proto"]
    assert labels.first_diagnostics(rows, "proto", 2).count() == 2
    flows = spark.createDataFrame([("a", 5, 9), ("a", 1, 2)], "k string, start_us long, end_us long")
    assert [(r["start_us"], r["seq"]) for r in labels.numbered(flows, "k").orderBy("seq").collect()] == [(1, 1), (5, 2)]
    text = spark.createDataFrame([(0.12345, "a" * 12)], "x double, t string").select(C.percent_text(F.col("x")), C.shortened(F.col("t")), C.port_or_zero(F.lit(None).cast("int"))).first()
    assert tuple(text) == ("12.345%", "a" * 10 + "..", 0)


def _intervals(spark, n: int, key_share: float, seed: int):
    import random

    r = random.Random(seed)
    rows = []
    for k in range(n):
        start = r.randrange(0, 200) * 900_000_000
        length = r.choice([0, 0, 900_000_000, 5_400_000_000, r.randrange(20_000_000_000)])
        rows.append(("hot" if r.random() < key_share else r.choice("abc"), start, start + length, k, k % 2, f"i{k}"))
    rows.append(("hot", 7, 10**17, n, 1, "wrong end"))
    rows.append(("a", -7_200_000_001, 3, n + 1, 1, "before the epoch"))
    rows.append(("a", 10, 9, n + 2, 1, "ends before it starts"))
    return rows, spark.createDataFrame(rows, "id string, start_us long, end_us long, seq long, traffic_type int, info string")


def test_overlaps_without_pairs(spark):
    rows, flows = _intervals(spark, 160, 0.6, 1)
    ok = [r for r in rows if r[2] >= r[1]]
    meets = lambda a, b: a[1] == b[1] or max(a[1], b[1]) < (a if a[1] < b[1] else b)[2]
    want = {}
    for r in ok:
        mine = [o for o in ok if o[0] == r[0]]
        chain, reach = r[1], None
        for o in sorted(mine, key=lambda o: o[1]):
            if o[1] > r[1]:
                break
            if reach is None or o[1] >= reach and o[1] != chain:
                chain = o[1]
            reach = max(reach or o[2], o[2])
        want[r[3]] = (sum(meets(r, o) for o in mine if o[3] != r[3]), chain)
    got = {r["seq"]: (r["n_overlaps"], r["group_us"]) for r in labels.overlaps(flows, "id").collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert got == want
    pairs = labels.duplicate_flows(flows, "id").collect()
    assert len(pairs) == len({(p["first_seq"], p["second_seq"]) for p in pairs}) == sum(v[0] for v in want.values()) / 2


def test_open_flows_by_dyadic_nodes(spark):
    rows, flows = _intervals(spark, 120, 0.5, 2)
    packets = [(k, "hot" if k % 2 else "a", t) for k, t in enumerate([-7_200_000_001, -1, 0, 7, 10**17, 10**17 + 1, *range(3, 180_000_000_000, 1_700_000_123)])]
    got = {r["pkt_idx"]: (r["traffic_type"], r["attack_type"], r["matched"]) for r in labels.asof_labels(spark.createDataFrame(packets, "pkt_idx long, id string, ts_us long"), flows, "id", use_end=True).collect()}
    for k, key, t in packets:
        best = max((r for r in rows if r[0] == key and r[1] <= t <= r[2]), key=lambda r: (r[1], r[4] == 0, r[3]), default=None)
        assert got[k] == ((best[4], best[5] if best[4] else None, True) if best else (0, None, False)), (k, t)
    nodes = flows.where("end_us >= start_us").select("start_us", "end_us", labels.dyadic_nodes("start_us", "end_us", labels.BUCKET).alias("n")).collect()
    for r in nodes:
        covered = sorted((x["node"] << x["level"], (x["node"] + 1) << x["level"]) for x in r["n"])
        a, b = r["start_us"] // labels.BUCKET, r["end_us"] // labels.BUCKET
        assert covered[0][0] == a and covered[-1][1] == b + 1 and all(x[1] == y[0] for x, y in zip(covered, covered[1:]))
        assert len(covered) <= 2 * max(1, (b - a + 1).bit_length())
