"""Flow features from captures, against values worked out by hand and against a loop over packets."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from flowsift.operators import extractors, flows, payl
from flowsift.operators.extractors import FlowSettings
from flowsift.plans import extract
from flowsift.sources import pcap
from tests.captures import cooked, ethernet, ip_packet, pcap_file, pcapng_file

A, B = "10.0.0.1", "10.0.0.9"


def hand_made() -> list[tuple[int, bytes]]:
    """A handshake, data, a pause and a FIN between A and B; one frame that is not IP; one UDP packet."""
    tcp = lambda t, out, flags, data=b"", ttl=64: (t, ethernet(ip_packet(*((A, B, 5000, 80) if out else (B, A, 80, 5000)), 6, flags, data, ttl)))
    return [
        tcp(1_000_000, True, 0x02), tcp(1_100_000, False, 0x12, ttl=60), tcp(1_150_000, True, 0x10), tcp(1_200_000, True, 0x18, b"abcd"), (1_300_000, b"\0" * 60),
        tcp(3_200_000, False, 0x18, b"xy", 60), tcp(3_300_000, True, 0x11), (3_400_000, ethernet(ip_packet(B, A, 53, 53, 17, data=b"zz"))),
    ]


@pytest.fixture(scope="module")
def packets(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("captures")
    (folder / "a.pcap").write_bytes(pcap_file(hand_made()))
    return pcap.read_pcap(spark, str(folder)).cache()


def test_flows_of_a_capture(packets):
    rows = {r["flow_idx"]: r for r in extractors.flow_features(packets, FlowSettings(frozenset({"subflows", "tcp", "with_ip_addr", "hindsight"}))).collect()}
    assert sorted(rows) == [0, 1, 2]
    r = rows[0]  # the FIN packet opens the next flow
    assert (r["flow_first"], r["src_port"], r["dest_port"], r["protocol"], r["src_ip"], r["dest_ip"]) == (0, 5000, 80, 6, 0x0A000001, 0x0A000009)
    lengths = [20, 20, 20, 24, 22]
    assert (r["total_sum_pkt_length"], r["total_n_packets"], r["fwd_n_packets"], r["bwd_n_packets"]) == (106, 5, 3, 2)
    assert r["total_std_pkt_length"] == pytest.approx(statistics.pstdev(lengths)) and r["bwd_avg_ttl"] == 60 and r["fwd_avg_ttl"] == 64
    assert r["total_packets_per_s"] == pytest.approx(5 / 2.2) and r["bwd_bytes_per_s"] == pytest.approx(42 / 2.1)
    assert (r["fwd_iat_min"], r["fwd_iat_max"], r["bwd_iat_sum"]) == pytest.approx((0.05, 0.15, 2.1))
    assert (r["n_subflows"], r["n_active_times"], r["n_idle_times"]) == (2, 2, 1) and (r["max_active_time"], r["min_active_time"], r["total_idle_time"]) == pytest.approx((0.2, 0.0, 2.0))
    assert (r["fwd_subflow_avg_pkts"], r["bwd_subflow_avg_pkts"], r["bwd_subflow_avg_length"]) == (3, 1, 21)
    assert [r[f"tcp_fwd_total_{n}"] for n in ("syn", "syn_ack", "ack", "push", "fin", "urg", "rst")] == [1, 0, 2, 1, 0, 0, 0] and r["tcp_bwd_total_syn_ack"] == 1 and r["tcp_fwd_win_mean"] == 512
    assert (r["tcp_syn_synack"], r["tcp_synack_ack"], r["tcp_rtt"]) == pytest.approx((0.1, 0.05, 0.15))
    r = rows[1]  # the FIN alone: no packets back
    assert (r["total_n_packets"], r["bwd_n_packets"], r["bwd_sum_pkt_length"], r["bwd_packets_per_s"], r["bwd_bytes_per_s"], r["tcp_bwd_total_fin"], r["tcp_fwd_total_fin"], r["tcp_rtt"]) == (1, 0, -1, 0, -1, -1, 1, -1)
    assert (r["total_iat_sum"], r["total_packets_per_s"], r["bwd_subflow_avg_pkts"], r["hindsight_src_addr"], r["hindsight_src_addr_prot"]) == (-1, 1, 0, 1, 1)
    assert [rows[2][c] for c in extractors.TCP] == [-1] * 19 and rows[2]["protocol"] == 17


def test_modes_are_checked_and_name_their_features(packets):
    for bad in ({"basic", "subflows"}, {"ip_dotted"}, {"tcp_end_on_rst"}, {"none"}):
        with pytest.raises(ValueError):
            FlowSettings(frozenset(bad))
    plain = extractors.flow_features(packets)
    assert len(extractors.feature_names(plain)) == 42
    dotted = extractors.flow_features(packets, FlowSettings(frozenset({"with_ip_addr", "ip_dotted", "port_decimal", "include_header_length"})))
    row = dotted.orderBy("flow_idx").first()
    assert [row[f"src_ip_dotted_{k}"] for k in (5, 4, 3, 2, 1)] == [-1, 10, 0, 0, 1] and row["src_port_digit_3"] == 5 and row["total_min_pkt_length"] == 40
    assert FlowSettings(frozenset({"tcp", "subflows"})).ident == FlowSettings(frozenset({"subflows", "tcp"})).ident != FlowSettings().ident
    assert [extractors.feature_type(n) for n in ("protocol", "fwd_n_packets", "fwd_iat_max", "tcp_fwd_total_syn", "protocol_ohe_6.0")] == ["categorical", "int", "float", "int", "binary"]


def test_packets_go_back_to_their_flows(packets):
    found = {r["pkt_idx"]: r["flow_first"] for r in extractors.packet_flows(packets, FlowSettings(frozenset({"tcp"}))).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 0, 4: None, 5: 0, 6: 6, 7: 7}
    verdicts = packets.sparkSession.createDataFrame([("a.pcap", 0, 1)], "file string, flow_first long, label int")
    labels = flows.map_back(extractors.packet_flows(packets, FlowSettings(frozenset({"tcp"}))), verdicts, ["file", "flow_first"])
    assert sorted(r["pkt_idx"] for r in labels.where("label = 1").collect()) == [0, 1, 2, 3, 5]


def test_features_against_a_loop(spark):
    r, rows = random.Random(3), []
    at = 0
    for i in range(600):
        at += r.choice([1000, 50_000, 700_000, 9_000_000, 13_000_000])
        a, b = r.choice([(1, 2), (2, 1), (1, 3), (3, 1), (2, 2)])
        rows.append(("f", i, at, 70_000 + a, 70_000 + b, 10 * a, 10 * b, r.choice([6, 17]), r.randint(1, 64), r.randint(28, 1500), r.choice([2, 18, 16, 17, 4])))
    frame = spark.createDataFrame(rows, "file string, pkt_idx long, ts_us long, src_ip long, dst_ip long, src_port int, dst_port int, protocol int, ttl int, ip_len int, flags int")
    frame = frame.withColumns({"l4_len": F.col("ip_len") - 20, "tcp_flags": F.expr("if(protocol = 6, flags, null)"), "tcp_win": F.col("ttl"), "payload": F.lit(b"")})
    got = {x["flow_first"]: x for x in extractors.flow_features(frame, FlowSettings(frozenset({"tcp", "tcp_end_on_rst", "subflows"}))).collect()}
    open_, found = {}, []
    for row in rows:
        _, i, t, s, d, sp, dp, proto, ttl, size, flags = row
        key = (s, d, sp, dp, proto) if s < d else (d, s, dp, sp, proto)
        old = open_.get(key)
        new = old is None or (bool(flags & 5) if proto == 6 else t - old[-1][2] > 12_000_000)
        if new:
            open_[key] = old = []
            found.append(old)
        old.append(row)
    assert sorted(got) == [f[0][1] for f in found] and [got[f[0][1]]["flow_idx"] for f in found] == list(range(len(found)))
    for f in found:
        x = got[f[0][1]]
        split = {"total": f, "fwd": [p for p in f if (p[3], p[5]) == (f[0][3], f[0][5])], "bwd": [p for p in f if (p[3], p[5]) != (f[0][3], f[0][5])]}
        for name, ps in split.items():
            gaps = [(b[2] - a[2]) / 1e6 for a, b in zip(ps, ps[1:])]
            sec = (ps[-1][2] - ps[0][2]) / 1e6 if ps else 0
            total = sum(p[9] - 20 for p in ps) if ps else -1
            assert (x[f"{name}_n_packets"], x[f"{name}_sum_pkt_length"]) == (len(ps), total)
            assert x[f"{name}_bytes_per_s"] == pytest.approx(total / sec if sec else total) and x[f"{name}_packets_per_s"] == pytest.approx(len(ps) / sec if sec else len(ps))
            assert x[f"{name}_iat_std"] == pytest.approx(statistics.pstdev(gaps) if gaps else -1) and x[f"{name}_iat_max"] == pytest.approx(max(gaps, default=-1))
            parts, last = 0, None
            for p in ps:
                parts, last = parts + (last is None or p[2] - last > 500_000), p[2]
            if name == "total":
                assert x["n_subflows"] == parts
            else:
                assert x[f"{name}_subflow_avg_pkts"] == pytest.approx(len(ps) / parts if parts else 0)
                assert x[f"tcp_{name}_total_fin"] == (sum(p[10] & 1 for p in ps) if ps and f[0][7] == 6 else -1)


def test_payload_features(packets):
    settings = FlowSettings(frozenset({"tcp"}))
    row = extractors.payload_flows(packets, settings).where("flow_first = 7").first()
    assert row["freq_byte_122"] == pytest.approx(2 / 10) and sum(row[f"freq_byte_{i}"] for i in range(256)) == pytest.approx(1)
    centroids = extractors.fit_payl(packets, settings)
    out = {r["flow_first"]: r for r in extractors.payl_flows(packets, centroids, settings).collect()}
    assert out[7]["mean_payl_dist"] == 0 and out[0]["max_payl_dist"] >= out[0]["min_payl_dist"] >= 0 and len(extractors.feature_names(extractors.payl_flows(packets, centroids, settings), settings)) == 61 + 4
    none = extractors.payl_flows(packets, centroids.limit(0), settings).first()
    assert none["mean_payl_dist"] == -1
    merged = extractors.fit_payl(packets, settings, clustering=3.0)
    assert merged.count() < centroids.count() and [r["length"] for r in payl.by_length(merged).collect()]


def test_packet_features(packets):
    rows = {r["pkt_idx"]: r for r in extractors.packet_features(packets).collect()}
    assert (rows[0]["is_tcp"], rows[0]["tcp_flags"], rows[0]["tcp_opts"], rows[0]["is_udp"], rows[0]["src_port"]) == (1, 2, 0, 0, 5000)
    assert (rows[7]["is_udp"], rows[7]["udp_len"], rows[7]["udp_sum"], rows[7]["is_tcp"]) == (1, 10, 7, 0)
    assert (rows[4]["src_ip"], rows[4]["src_port"], rows[4]["frame_len"], rows[4]["tcp_flags"]) == (-1000, -1000, 60, 0)


@pytest.mark.parametrize("extractor", ["flow_extractor", "flows_payload", "payl_flows"])
def test_features_as_a_file(spark, tmp_path, extractor):
    (tmp_path / "a.pcap").write_bytes(pcap_file(hand_made()))
    rows = extract.extract_flows(spark, f"{tmp_path}/a.pcap", f"{tmp_path}/out", extractor, FlowSettings(frozenset({"tcp"})), one_hot=True)
    back = spark.read.option("header", True).csv(f"{tmp_path}/out")
    assert rows.count() == back.count() == 3 and {"protocol_ohe_6", "protocol_ohe_17"} <= set(back.columns) and "protocol" not in back.columns
    assert ("freq_byte_255" in back.columns, "std_payl_dist" in back.columns) == (extractor == "flows_payload", extractor == "payl_flows")


def test_made_up_features(spark):
    assert extractors.test_features(spark, 3, True).count() == 12
    assert [r["features"] for r in extractors.test_features(spark, 4, False).orderBy("pkt_idx").collect()] == [[-100.0, -200.0], [1.0, 1.0], [1.0, 1.0], [-100.0, -200.0]]


def test_captures_of_both_formats_and_layers(spark, tmp_path):
    packet = ip_packet(A, B, 1, 2, 17)
    (tmp_path / "a.pcapng").write_bytes(pcapng_file([(5_000_001, ethernet(packet)), (6_000_000, b"\0" * 9)]))
    (tmp_path / "b.pcap").write_bytes(pcap_file([(7, cooked(packet))], 113))
    (tmp_path / "c.pcap").write_bytes(pcap_file([(8, cooked(packet))], 12345))
    rows = {(r["file"], r["pkt_idx"]): r for r in pcap.read_pcap(spark, str(tmp_path)).collect()}
    assert rows["a.pcapng", 0]["ts_us"] == 5_000_001 and rows["a.pcapng", 1]["src_ip"] is None
    assert all(rows[k]["src_ip"] == 0x0A000001 for k in (("a.pcapng", 0), ("b.pcap", 0), ("c.pcap", 0)))
    hinted = {(r["file"], r["pkt_idx"]): r["src_ip"] for r in pcap.read_pcap(spark, str(tmp_path), linklayer="sll").collect()}
    assert hinted["a.pcapng", 0] is None and hinted["b.pcap", 0] == 0x0A000001


def test_a_cut_capture_is_an_error(spark, tmp_path):
    whole = pcap_file([(1, ethernet(ip_packet(A, B, 1, 2))), (2, ethernet(ip_packet(A, B, 1, 2)))])
    (tmp_path / "a.pcap").write_bytes(whole[:-5])
    with pytest.raises(Exception, match="ends inside"):
        pcap.read_pcap(spark, str(tmp_path)).count()
    assert pcap.read_pcap(spark, str(tmp_path), truncated="stop").count() == 1
