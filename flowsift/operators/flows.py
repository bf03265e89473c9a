"""Packets to flows and per-flow features, by window and group expressions only.

Packets need: pkt_idx (arrival order), ts_us (integer microseconds) and the key columns. Statistics over an empty
set of packets are -1, sums of rates excepted; they are null inside and coalesced once, at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.functions.columns import ACK, FIN, PSH, RST, SYN, URG, flag_set

Boundary = Column


def sessionize(packets: DataFrame, keys: list[str], timeout_us: int, fin: Column | None = None, is_tcp: Column | None = None, timeout_and_fin: bool = False, width: int | None = None) -> DataFrame:
    """Adds flow_seq (in its key), flow_first (pkt_idx that opened it).

    A flow ends when the gap to the key's previous packet is over the timeout. With fin, packets for which is_tcp holds end
    flows by fin alone, and the fin packet opens the next flow; timeout_and_fin lets both end a flow. width: packets of a key are dealt by ranges of so many
    pkt_idx, for keys that hold more than a task can; ranges hand on what was open in one row each.
    """

    def opens(before: Column) -> Column:
        """Whether a packet opens a flow, by the time of the packet before it."""
        boundary = F.col("ts_us") - before > timeout_us
        if fin is not None:
            tcp = is_tcp if is_tcp is not None else F.lit(True)
            boundary = F.when(tcp, (fin | boundary) if timeout_and_fin else fin).otherwise(boundary)
        return before.isNull() | boundary

    if width:
        return _sessions_by_ranges(packets, keys, opens, width)
    order = Window.partitionBy(*keys).orderBy("pkt_idx")
    rows = packets.withColumn("__new", F.when(opens(F.lag("ts_us").over(order)), 1).otherwise(0))
    rows = rows.withColumn("flow_seq", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("flow_first", F.min("pkt_idx").over(Window.partitionBy(*keys, "flow_seq"))).drop("__new")


def _sessions_by_ranges(packets: DataFrame, keys: list[str], opens, width: int) -> DataFrame:
    rows = packets.withColumn("__r", F.floor(F.col("pkt_idx") / width))
    inside = Window.partitionBy(*keys, "__r").orderBy("pkt_idx")
    rows = rows.withColumn("__before", F.lag("ts_us").over(inside)).withColumn("__head", F.row_number().over(inside) == 1)
    # all but the first packet of a range know what was before them
    rows = rows.withColumn("__new", ~F.col("__head") & F.coalesce(opens(F.col("__before")), F.lit(False)))
    needed = [c for c in packets.columns if c not in keys]
    ranges = rows.groupBy(*keys, "__r").agg(F.max_by("ts_us", "pkt_idx").alias("__end"), F.count_if("__new").alias("__n"), F.max(F.when(F.col("__new"), F.col("pkt_idx"))).alias("__last"), *[F.min_by(c, "pkt_idx").alias(c) for c in needed])
    earlier = Window.partitionBy(*keys).orderBy("__r")
    ranges = ranges.withColumn("__opens", opens(F.lag("__end").over(earlier)))
    so_far = earlier.rowsBetween(Window.unboundedPreceding, -1)
    mine = F.col("__opens").cast("long")
    opened = F.coalesce(F.col("__last"), F.when(F.col("__opens"), F.col("pkt_idx")))
    ranges = ranges.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__r").alias("__range"), (F.coalesce(F.sum(F.col("__n") + mine).over(so_far), F.lit(0)) + mine).alias("__base"), F.coalesce(F.when(F.col("__opens"), F.col("pkt_idx")), F.last(opened, ignorenulls=True).over(so_far)).alias("__open"))
    same = (rows["__r"] == ranges["__range"]) & reduce(lambda x, y: x & y, [rows[k].eqNullSafe(ranges[f"__k_{k}"]) for k in keys])
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"__seq": F.sum(F.col("__new").cast("long")).over(upto), "__first": F.last(F.when(F.col("__new"), F.col("pkt_idx")), ignorenulls=True).over(upto)}).join(ranges, same)
    return rows.select(*packets.columns, (F.col("__base") + F.col("__seq")).alias("flow_seq"), F.coalesce("__first", "__open").alias("flow_first"))


def flow_index(flows: DataFrame, order: str = "flow_first", width: int = 1 << 20, by: list[str] = ()) -> DataFrame:
    """Adds flow_idx, the dense 0-based rank of unique `order` (in each group of `by`), over ranges of `width` instead of one sorted partition."""
    part = flows.withColumn("__b", F.floor(F.col(order) / width))
    sizes = part.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    rank = F.row_number().over(Window.partitionBy(*by, "__b").orderBy(order)) - 1
    return part.withColumn("__r", rank).join(before, [*by, "__b"]).withColumn("flow_idx", F.col("__r") + F.col("__before")).drop("__b", "__r", "__before")


def or_missing(c: Column, missing: float = -1.0) -> Column:
    return F.coalesce(c, F.lit(missing))


def length_stats(rows: DataFrame, by: list[str], length: str = "length", prefix: str = "total") -> DataFrame:
    v = F.col(length)
    named = {"sum": F.sum(v), "mean": F.avg(v), "min": F.min(v), "max": F.max(v), "std": F.stddev_pop(v)}
    return rows.groupBy(*by).agg(*[or_missing(c).alias(f"{prefix}_{n}_pkt_length") for n, c in named.items()], F.count(v).alias(f"{prefix}_n_packets"))


def rates(rows: DataFrame, by: list[str], length: str = "length", prefix: str = "total") -> DataFrame:
    """Packets and bytes per second; a duration of zero gives the count and the sum themselves."""
    n, total, seconds = F.count("*"), F.sum(length), (F.max_by("ts_us", "pkt_idx") - F.min_by("ts_us", "pkt_idx")) / 1e6
    rate = lambda v: F.when(seconds == 0, v.cast("double")).otherwise(v / F.nullif(seconds, F.lit(0.0)))
    return rows.groupBy(*by).agg(rate(n).alias(f"{prefix}_packets_per_s"), or_missing(rate(total)).alias(f"{prefix}_bytes_per_s"))


def inter_arrival(rows: DataFrame, by: list[str], prefix: str = "total") -> DataFrame:
    gap = (F.col("ts_us") - F.lag("ts_us").over(Window.partitionBy(*by).orderBy("pkt_idx"))) / 1e6
    gaps = rows.withColumn("__gap", gap)
    named = {"std": F.stddev_pop("__gap"), "min": F.min("__gap"), "max": F.max("__gap"), "sum": F.sum("__gap")}
    return gaps.groupBy(*by).agg(*[or_missing(c).alias(f"{prefix}_iat_{n}") for n, c in named.items()])


def with_direction(rows: DataFrame, by: list[str], source: list[str], first_only: bool = False) -> DataFrame:
    """Adds forward: whether a packet's source is that of the flow's first packet; first_only: the first packet alone."""
    order = Window.partitionBy(*by).orderBy("pkt_idx")
    if first_only:
        return rows.withColumn("forward", F.row_number().over(order) == 1)
    same = None
    for c in source:
        one = F.col(c).eqNullSafe(F.first(c).over(order))
        same = one if same is None else same & one
    return rows.withColumn("forward", same)


def subflows(rows: DataFrame, by: list[str], timeout_us: int) -> DataFrame:
    """Adds subflow_seq inside each group of `by`."""
    order = Window.partitionBy(*by).orderBy("pkt_idx")
    new = F.when(F.col("ts_us") - F.lag("ts_us").over(order) > timeout_us, 1).otherwise(0)
    return rows.withColumn("__new", new).withColumn("subflow_seq", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def active_idle(rows: DataFrame, by: list[str], timeout_us: int) -> DataFrame:
    """Thirteen features of active spans and idle gaps."""
    spans = subflows(rows, by, timeout_us).groupBy(*by, "subflow_seq").agg(F.min_by("ts_us", "pkt_idx").alias("a"), F.max_by("ts_us", "pkt_idx").alias("z"))
    spans = spans.withColumn("active", (F.col("z") - F.col("a")) / 1e6).withColumn("idle", (F.col("a") - F.lag("z").over(Window.partitionBy(*by).orderBy("subflow_seq"))) / 1e6)
    out = [F.count("*").alias("n_subflows")]
    for n in ("active", "idle"):
        out.append(F.count(n).alias(f"n_{n}_times"))
        out += [or_missing(f(n), 0.0).alias(f"{k}_{n}_time") for k, f in (("min", F.min), ("max", F.max), ("total", F.sum), ("std", F.stddev_pop), ("mean", F.avg))]
    return spans.groupBy(*by).agg(*out)


def subflow_averages(rows: DataFrame, by: list[str], timeout_us: int, length: str = "length") -> DataFrame:
    """Mean packets and bytes of a subflow in each direction; a direction is split on its own."""
    parts = subflows(rows, [*by, "forward"], timeout_us).groupBy(*by, "forward", "subflow_seq").agg(F.count("*").alias("n"), F.sum(length).alias("s"))
    out = []
    for d, own in (("fwd", F.col("forward")), ("bwd", ~F.col("forward"))):
        out += [or_missing(F.avg(F.when(own, F.col(c))), 0.0).alias(f"{d}_subflow_avg_{n}") for c, n in (("n", "pkts"), ("s", "length"))]
    return parts.groupBy(*by).agg(*out)


def hindsight_counts(flows: DataFrame, keys: dict[str, list[str]], previous: int, width: int = 1 << 14) -> DataFrame:
    """How many of the `previous` flows before, by dense flow_idx, agree in each set of columns.

    Flows are counted by ranges of flow_idx (of `width`, or `previous` if that is more), each with the last `previous` flows of the range before it, so no
    task holds more of a key than that, however many flows have it."""
    width = max(width, previous)
    own = F.floor(F.col("flow_idx") / width)
    ahead = F.col("flow_idx") >= (own + 1) * width - previous
    ranges = F.when(ahead, F.array(own, own + 1)).otherwise(F.array(own))
    rows = flows.withColumn("__range", F.explode(ranges))
    for name, cols in keys.items():
        rows = rows.withColumn(f"hindsight_{name}", F.count("*").over(Window.partitionBy(*cols, "__range").orderBy("flow_idx").rangeBetween(-previous, -1)))
    return rows.where(F.col("__range") == own).drop("__range")


def tcp_counts(own: Column, flags: str = "tcp_flags", window: str = "tcp_win", prefix: str = "fwd") -> list[Column]:
    """Aggregates over the packets that `own` picks: mean window and counts of flags; -1 without such packets. Packets that are not TCP have null flags."""
    f = F.col(flags)
    syn, ack = flag_set(f, SYN), flag_set(f, ACK)
    named = {"urg": flag_set(f, URG), "syn": syn & ~ack, "syn_ack": syn & ack, "ack": ack & ~syn, "fin": flag_set(f, FIN), "push": flag_set(f, PSH), "rst": flag_set(f, RST)}
    some = F.count(F.when(own, f)) > 0
    mean = or_missing(F.avg(F.when(own & f.isNotNull(), F.col(window)))).alias(f"tcp_{prefix}_win_mean")
    return [mean, *[F.when(some, F.count_if(own & c)).otherwise(-1).alias(f"tcp_{prefix}_total_{n}") for n, c in named.items()]]


def tcp_counters(rows: DataFrame, by: list[str], flags: str = "tcp_flags", window: str = "tcp_win", prefix: str = "fwd", own: Column | None = None) -> DataFrame:
    """Mean window and counts of flags of the packets of one direction; -1 where a flow has none that are TCP."""
    return rows.groupBy(*by).agg(*tcp_counts(own if own is not None else F.lit(True), flags, window, prefix))


def with_handshake(rows: DataFrame, by: list[str], syn: Column, synack: Column, ack: Column, source: str | None = None, target: str | None = None) -> DataFrame:
    """Adds to each packet the times __syn, __synack, __ack of its group: the first SYN, the first later SYN-ACK that goes to the SYN's source, and the
    first later ACK that comes from it. Without source and target (columns), all packets qualify."""
    group = Window.partitionBy(*by)
    place = F.struct("pkt_idx", "ts_us", (F.col(source) if source else F.lit(0)).alias("from"))
    first = lambda c: F.min(F.when(c, place)).over(group)
    after = lambda c: F.col("pkt_idx") > F.col(f"{c}.pkt_idx")
    same = lambda c: F.col(c) == F.col("__syn.from") if c else F.lit(True)
    rows = rows.withColumn("__syn", first(syn))
    rows = rows.withColumn("__synack", first(synack & after("__syn") & same(target)))
    return rows.withColumn("__ack", first(ack & after("__synack") & same(source)))


def handshake_gaps() -> list[Column]:
    """Aggregates over with_handshake(): all -1 unless all three packets exist."""
    at = lambda c: F.max(f"__{c}.ts_us")
    gap = lambda x, y: or_missing(F.when(at("ack").isNotNull(), (at(y) - at(x)) / 1e6))
    return [gap("syn", "synack").alias("tcp_syn_synack"), gap("synack", "ack").alias("tcp_synack_ack"), gap("syn", "ack").alias("tcp_rtt")]


def handshake(rows: DataFrame, by: list[str], syn: Column, synack: Column, ack: Column, source: str | None = None, target: str | None = None) -> DataFrame:
    return with_handshake(rows, by, syn, synack, ack, source, target).groupBy(*by).agg(*handshake_gaps())


def map_back(packets: DataFrame, verdicts: DataFrame, on: list[str], label: str = "label") -> DataFrame:
    """Flow verdicts on packets; packets without a flow are benign."""
    return packets.join(verdicts, on, "left").withColumn(label, F.coalesce(F.col(label), F.lit(0)))
