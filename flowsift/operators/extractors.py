"""Feature extractors: packets to one row of features for each flow, in the contractual column order.

Packets are those of the capture source (sources.pcap.SCHEMA): pkt_idx, ts_us, src_ip, dst_ip, src_port, dst_port, protocol, ttl, ip_len, l4_len,
tcp_flags, tcp_win, payload. `by` names columns that tell sequences of packets apart (file, traffic_name); pkt_idx is unique in each. All features of
a flow come from one shuffle by flow key: windows and the aggregate work on its partitions. A flow is known by by and flow_first, the
pkt_idx of its first packet; flow_idx numbers flows from 0 in the order of their first packets.

Packets that are not IPv4 (null src_ip) belong to no flow. Features without packets are -1 but for n_packets, rates of packets and the
active, idle and subflow features, which are 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsift.functions import columns as C
from flowsift.operators import flows, payl

MODES = ("subflows", "with_ip_addr", "tcp", "include_header_length", "hindsight", "ip_dotted", "port_decimal", "basic", "tcp_end_on_rst")
KEY = ["ip_a", "ip_b", "port_a", "port_b", "protocol"]
HINDSIGHT = {
    "dest_addr_src_port": ["dest_ip", "src_port"], "src_addr_dest_port": ["src_ip", "dest_port"], "src_addr": ["src_ip"], "dest_addr": ["dest_ip"],
    "dest_addr_prot": ["dest_ip", "protocol"], "src_addr_prot": ["src_ip", "protocol"],
}


@dataclass(frozen=True)
class FlowSettings:
    """Timeouts in microseconds; modes are checked when the settings are made."""

    modes: frozenset[str] = frozenset()
    timeout_us: int = 12_000_000
    subflow_us: int = 500_000
    hindsight: int = 100
    first_only: bool = False
    timeout_and_fin: bool = False
    by: tuple[str, ...] = field(default=("file",))

    def __post_init__(self) -> None:
        object.__setattr__(self, "modes", frozenset(self.modes))
        if unknown := self.modes - set(MODES):
            raise ValueError(f"unknown modes {sorted(unknown)}")
        if "basic" in self.modes and self.modes - {"basic", "tcp"}:
            raise ValueError("basic goes with no other mode than tcp")
        if "ip_dotted" in self.modes and "with_ip_addr" not in self.modes:
            raise ValueError("ip_dotted needs with_ip_addr")
        if "tcp_end_on_rst" in self.modes and "tcp" not in self.modes:
            raise ValueError("tcp_end_on_rst needs tcp")

    @property
    def ident(self) -> str:
        """Equal for settings that give equal features: the key of a feature cache."""
        parts = [f"timeout={self.timeout_us / 1e6:g}", f"modes={sorted(self.modes)}"]
        parts += [f"sf_timeout={self.subflow_us / 1e6:g}"] * ("subflows" in self.modes) + [f"hindsight_window={self.hindsight}"] * ("hindsight" in self.modes)
        parts += ["first_only"] * self.first_only + ["timeout_and_fin"] * self.timeout_and_fin
        return f"FlowExtractor({', '.join(parts)})"

    @property
    def flow(self) -> list[str]:
        return [*self.by, "flow_first"]


def flow_rows(packets: DataFrame, settings: FlowSettings = FlowSettings()) -> DataFrame:
    """The IPv4 packets with their flow: key columns, flow_seq, flow_first, forward."""
    key = C.flow_key(F.col("src_ip"), F.col("dst_ip"), C.port_or_zero(F.col("src_port")), C.port_or_zero(F.col("dst_port")), F.col("protocol"))
    rows = packets.where(F.col("src_ip").isNotNull()).withColumn("__key", key).select("*", *[F.col(f"__key.{k}").alias(k) for k in KEY[:-1]]).drop("__key")
    fin = None
    if "tcp" in settings.modes:
        mask = C.FIN | (C.RST if "tcp_end_on_rst" in settings.modes else 0)
        fin = F.coalesce(C.flag_set(F.col("tcp_flags"), mask), F.lit(False))
    keys = [*settings.by, *KEY]
    rows = flows.sessionize(rows, keys, settings.timeout_us, fin, F.col("tcp_flags").isNotNull(), settings.timeout_and_fin)
    return flows.with_direction(rows, [*keys, "flow_seq"], ["src_ip", "src_port"], settings.first_only)


def packet_flows(packets: DataFrame, settings: FlowSettings = FlowSettings()) -> DataFrame:
    """by, pkt_idx, flow_first of every packet; null for those without a flow."""
    own = flow_rows(packets, settings).select(*settings.flow, "pkt_idx")
    return packets.select(*settings.by, "pkt_idx").join(own, [*settings.by, "pkt_idx"], "left")


def direction_features(prefix: str, own: Column, gap: str, length: str) -> list[Column]:
    """The 13 statistics of one list of packets."""
    pick = lambda c: F.when(own, F.col(c))
    n, total = F.count_if(own), F.sum(pick(length))
    seconds = (F.max_by("ts_us", pick("pkt_idx")) - F.min_by("ts_us", pick("pkt_idx"))) / 1e6
    rate = lambda v: F.when(F.coalesce(seconds, F.lit(0.0)) == 0, v.cast("double")).otherwise(v / F.nullif(seconds, F.lit(0.0)))
    v, g = pick(length), F.when(own, F.col(gap))
    named = {
        "sum_pkt_length": total, "mean_pkt_length": F.avg(v), "min_pkt_length": F.min(v), "max_pkt_length": F.max(v), "std_pkt_length": F.stddev_pop(v), "n_packets": n,
        "packets_per_s": rate(n), "bytes_per_s": rate(total), "avg_ttl": F.avg(pick("ttl")), "iat_std": F.stddev_pop(g), "iat_min": F.min(g), "iat_max": F.max(g), "iat_sum": F.sum(g),
    }
    return [flows.or_missing(c, -1).alias(f"{prefix}_{k}") for k, c in named.items()]


def _subflow_features(limit: float, length: str) -> list[Column]:
    """Active and idle times and averages of subflows. An idle time is a gap over the limit; an active time ends where none follows."""
    out = [(F.count_if(F.col("gap") > limit) + 1).alias("n_subflows")]
    for name, times in (("active", F.col("active")), ("idle", F.when(F.col("gap") > limit, F.col("gap")))):
        out.append(F.count(times).alias(f"n_{name}_times"))
        out += [flows.or_missing(f(times), 0.0).alias(f"{k}_{name}_time") for k, f in (("min", F.min), ("max", F.max), ("total", F.sum), ("std", F.stddev_pop), ("mean", F.avg))]
    for d, own in (("fwd", F.col("forward")), ("bwd", ~F.col("forward"))):
        parts = F.count_if(own & (F.col("own_gap").isNull() | (F.col("own_gap") > limit)))
        out += [flows.or_missing(total / F.nullif(parts, F.lit(0)), 0.0).alias(f"{d}_subflow_avg_{n}") for n, total in (("pkts", F.count_if(own)), ("length", F.sum(F.when(own, F.col(length)))))]
    return out


def _ports(settings: FlowSettings) -> list[Column]:
    ports = [F.coalesce(F.col(c), F.lit(0)) for c in ("src_port", "dest_port")]
    if "port_decimal" in settings.modes:
        return [d for p, n in zip(ports, ("src_port", "dest_port")) for d in C.port_digits(p, n)]
    return [p.alias(n) for p, n in zip(ports, ("src_port", "dest_port"))]


def flow_features(packets: DataFrame, settings: FlowSettings = FlowSettings()) -> DataFrame:
    """by, flow_first, flow_idx and the features of each flow that the settings' modes ask for."""
    modes, keys = settings.modes, [*settings.by, *KEY, "flow_seq"]
    rows = flow_rows(packets, settings)
    length = "ip_len" if "include_header_length" in modes else "l4_len"
    order, own_order = Window.partitionBy(*keys).orderBy("pkt_idx"), Window.partitionBy(*keys, "forward").orderBy("pkt_idx")
    head = {"src_ip": F.min_by("src_ip", "pkt_idx"), "dest_ip": F.min_by("dst_ip", "pkt_idx"), "src_port": F.min_by("src_port", "pkt_idx"), "dest_port": F.min_by("dst_port", "pkt_idx")}
    aggs = [F.first("flow_first").alias("flow_first"), *[c.alias(f"head_{n}") for n, c in head.items()]]
    names: list[str] = []
    if "basic" not in modes:
        since = lambda w: (F.col("ts_us") - F.lag("ts_us").over(w)) / 1e6
        rows = rows.withColumns({"gap": since(order), "own_gap": since(own_order)})
        parts = [("total", F.lit(True), "gap"), ("fwd", F.col("forward"), "own_gap"), ("bwd", ~F.col("forward"), "own_gap")]
        stats = [c for p in parts for c in direction_features(*p, length)]
        names, aggs = [f"{p}_{n}" for p in ("total", "fwd", "bwd") for n in STATISTICS], aggs + stats
    limit = settings.subflow_us / 1e6
    if "subflows" in modes:
        start = F.last(F.when(F.col("gap").isNull() | (F.col("gap") > limit), F.col("ts_us")), ignorenulls=True).over(order)
        next_gap = (F.lead("ts_us").over(order) - F.col("ts_us")) / 1e6
        rows = rows.withColumn("active", F.when(next_gap.isNull() | (next_gap > limit), (F.col("ts_us") - start) / 1e6))
        aggs += _subflow_features(limit, length)
        names += SUBFLOW
    if "tcp" in modes and "basic" not in modes:
        f = F.col("tcp_flags")
        syn, ack = C.flag_set(f, C.SYN), C.flag_set(f, C.ACK)
        rows = flows.with_handshake(rows, keys, syn & ~ack, syn & ack, ack & ~syn, "src_ip", "dst_ip")
        aggs += [*flows.tcp_counts(F.col("forward"), prefix="fwd"), *flows.tcp_counts(~F.col("forward"), prefix="bwd"), *flows.handshake_gaps()]
        names += TCP
    found = rows.groupBy(*keys).agg(*aggs).drop("ip_a", "ip_b", "port_a", "port_b", "flow_seq")
    found = flows.flow_index(found.withColumnsRenamed({f"head_{n}": n for n in head}), by=list(settings.by))
    if "hindsight" in modes:
        found = flows.hindsight_counts(found, {n: [*settings.by, *cols] for n, cols in HINDSIGHT.items()}, settings.hindsight)
    addresses: list = []
    if "with_ip_addr" in modes:
        addresses = ["src_ip", "dest_ip"] if "ip_dotted" not in modes else [c for n in ("src_ip", "dest_ip") for c in C.ip_octets(F.col(n), n)]
    plain = names[: 3 * len(STATISTICS)]
    return found.select(*settings.flow, "flow_idx", *_ports(settings), "protocol", *plain, *addresses, *names[len(plain) :], *[f"hindsight_{n}" for n in HINDSIGHT if "hindsight" in modes])


STATISTICS = ["sum_pkt_length", "mean_pkt_length", "min_pkt_length", "max_pkt_length", "std_pkt_length", "n_packets", "packets_per_s", "bytes_per_s", "avg_ttl", "iat_std", "iat_min", "iat_max", "iat_sum"]
_TIMES = [f"{k}_{n}_time" for n in ("active", "idle") for k in ("min", "max", "total", "std", "mean")]
SUBFLOW = ["n_subflows", "n_active_times", *_TIMES[:5], "n_idle_times", *_TIMES[5:], *[f"{d}_subflow_avg_{n}" for d in ("fwd", "bwd") for n in ("pkts", "length")]]
TCP = [*[f"tcp_{d}_{n}" for d in ("fwd", "bwd") for n in ("win_mean", "total_urg", "total_syn", "total_syn_ack", "total_ack", "total_fin", "total_push", "total_rst")], "tcp_syn_synack", "tcp_synack_ack", "tcp_rtt"]


def feature_names(features: DataFrame, settings: FlowSettings = FlowSettings()) -> list[str]:
    return [c for c in features.columns if c not in (*settings.flow, "flow_idx")]


def feature_type(name: str) -> str:
    """int, float, categorical or binary, by the name of a feature."""
    if name == "protocol" or "_digit_" in name or "_dotted_" in name:
        return "categorical"
    if "_ohe_" in name:
        return "binary"
    counts = ("_n_packets", "_sum_pkt_length", "n_subflows", "n_active_times", "n_idle_times")
    return "int" if name.endswith(("_port", "_ip", *counts)) or name in counts or "_total_" in name and name.startswith("tcp") or name.startswith("hindsight") else "float"


def as_vectors(features: DataFrame, settings: FlowSettings = FlowSettings(), column: str = "features") -> DataFrame:
    """by, flow_first, flow_idx and one array of all features, in their order."""
    return features.select(*settings.flow, "flow_idx", F.array(*[F.col(c).cast("double") for c in feature_names(features, settings)]).alias(column))


def combine(features: DataFrame, more: DataFrame, settings: FlowSettings = FlowSettings()) -> DataFrame:
    """The features of both, those of `more` behind; flows that `more` lacks have nulls."""
    return features.join(more, settings.flow, "left")


def payload_shares(rows: DataFrame, flow: list[str], payload: str = "payload") -> DataFrame:
    """flow and freq_byte_0 to freq_byte_255: shares of the bytes of all payloads of a flow; zeros without bytes."""
    counts = payl.byte_counts(rows, payload, flow)
    long = counts.select(*flow, F.posexplode("counts").alias("byte", "n")).where("n > 0").groupBy(*flow, "byte").agg(F.sum("n").alias("n"))
    whole = long.groupBy(*flow).agg(F.map_from_entries(F.collect_list(F.struct("byte", "n"))).alias("m"), F.sum("n").alias("total"))
    every = rows.select(*flow).distinct().join(whole, flow, "left")
    return every.select(*flow, *[F.coalesce(F.try_element_at("m", F.lit(i)) / F.col("total"), F.lit(0.0)).alias(f"freq_byte_{i}") for i in range(256)])


def payload_flows(packets: DataFrame, settings: FlowSettings = FlowSettings()) -> DataFrame:
    """Flow features and the byte shares of their payloads (the bytes behind the IP header)."""
    return combine(flow_features(packets, settings), payload_shares(flow_rows(packets, settings).select(*settings.flow, "payload"), settings.flow), settings)


def payl_packets(rows: DataFrame) -> DataFrame:
    """The IPv4 packets with bytes as PAYL sees them: port is the destination's, length that of the payload."""
    rows = rows.where(F.col("src_ip").isNotNull() & (F.octet_length("payload") > 0))
    return rows.withColumns({"port": F.col("dst_port"), "length": F.octet_length("payload")})


def fit_payl(packets: DataFrame, settings: FlowSettings = FlowSettings(), clustering: float = 0.0) -> DataFrame:
    """Centroids of the packets' payloads, neighbours nearer than `clustering` merged (0: none)."""
    found = payl.payload_centroids(payl_packets(packets))
    return payl.cluster(found, clustering) if clustering > 0 else found


def payl_flows(packets: DataFrame, centroids: DataFrame, settings: FlowSettings = FlowSettings(), smoothing: float = 1e-4, paper: bool = True) -> DataFrame:
    """Flow features and mean, min, max and deviation of the PAYL distances of a flow's packets (-1 without bytes)."""
    rows = payl_packets(flow_rows(packets, settings)).select(*settings.flow, *payl.KEY, "payload")
    far = payl.payload_distances(rows, centroids, settings.flow, "payload", smoothing, paper)
    out = combine(flow_features(packets, settings), payl.flow_distances(far, settings.flow), settings)
    return out.fillna(-1.0, [f"{n}_payl_dist" for n in ("mean", "min", "max", "std")])


def packet_features(frames: DataFrame) -> DataFrame:
    """Twelve features of each packet, as the packet extractor means them: frame_len, addresses and ports (-1000 where there are none), then
    is_tcp, tcp_opts, tcp_urp, tcp_flags (0 unless TCP), is_udp, udp_len, udp_sum (0 unless UDP). frames: file, pkt_idx, frame_len and the decoded columns."""
    none = lambda c: F.coalesce(F.col(c), F.lit(-1000))
    tcp, udp = F.col("protocol") == C.TCP, F.col("protocol") == C.UDP
    number = lambda a, n: F.conv(F.hex(F.substring("payload", a, n)), 16, 10).cast("long")
    offset = F.shiftright(number(13, 1), 4).cast("int") * 4
    options = F.when(offset > 20, F.conv(F.hex(F.expr("substring(payload, 21, 8)")), 16, 10).cast("decimal(20,0)").cast("double"))
    ports = lambda c: F.when(tcp | udp, F.col(c)).otherwise(-1000)
    zero = lambda own, c: F.coalesce(F.when(own, c), F.lit(0))
    return frames.select(
        "file", "pkt_idx", F.col("frame_len"), none("src_ip").alias("src_ip"), none("dst_ip").alias("dest_ip"), F.coalesce(ports("src_port"), F.lit(-1000)).alias("src_port"), F.coalesce(ports("dst_port"), F.lit(-1000)).alias("dest_port"),
        zero(tcp, F.lit(1)).alias("is_tcp"), zero(tcp, options).alias("tcp_opts"), zero(tcp, number(19, 2)).alias("tcp_urp"), zero(tcp, F.col("tcp_flags")).alias("tcp_flags"),
        zero(udp, F.lit(1)).alias("is_udp"), zero(udp, number(5, 2)).alias("udp_len"), zero(udp, number(7, 2)).alias("udp_sum"),
    )


def test_features(spark: SparkSession, n: int, training: bool) -> DataFrame:
    """Made-up features: for training four rows (1, 1), (0, 1), (1, 0), (0, 0) a packet; else (-100, -200) on every third packet and (1, 1) on the others."""
    rows = spark.range(n).withColumnRenamed("id", "pkt_idx")
    if training:
        values = F.posexplode(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in ((1.0, 1.0), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0))]))
        return rows.select("pkt_idx", values.alias("row", "features"))
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    return rows.select("pkt_idx", F.lit(0).alias("row"), F.when(F.col("pkt_idx") % 3 == 0, pair(-100.0, -200.0)).otherwise(pair(1.0, 1.0)).alias("features"))
