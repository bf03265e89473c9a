"""flow_features(): the flow extractor as a table function, so that SQL alone asks for features.

    SELECT * FROM flow_features(TABLE(packets), modes => 'tcp subflows', timeout => 12.0)

analyze() checks the settings, gives the schema that the modes ask for, reads only the needed columns and has Spark deal the packets by flow key in the order
of pkt_idx; a call therefore names no partitioning. A key's packets pass one by one: what is held is one open flow as sums, counts and extremes, however many
packets or flows a key has. Packets without an address are dealt by their number and give nothing.

Rows have the columns of extractors.flow_features() but for flow_idx and hindsight counts, which are over the flows of all keys: SQL windows over the result
give these. Addresses and ports in digits are SQL expressions too; their modes raise an error here. An empty table gives no rows. Null lengths and
ttls are left out of their statistics; columns beside the needed ones are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn

from flowsift.functions.columns import ACK, FIN, PSH, RST, SYN, URG
from flowsift.operators.extractors import STATISTICS, SUBFLOW, TCP, FlowSettings

NAME = "flow_features"
MODES = {"subflows", "tcp", "include_header_length", "tcp_end_on_rst", "with_ip_addr", "basic"}
_COUNTS = ("sum_pkt_length", "min_pkt_length", "max_pkt_length", "n_packets")
#: the flags that must be set of those that are looked at, for each counter in the order of its features
_FLAGS = [(URG, URG), (SYN | ACK, SYN), (SYN | ACK, SYN | ACK), (SYN | ACK, ACK), (FIN, FIN), (PSH, PSH), (RST, RST)]


class Spread:
    """Count, sum, extremes and deviation of numbers that are seen once."""

    __slots__ = ("n", "total", "low", "high", "mean", "squares")

    def __init__(self) -> None:
        self.n, self.total, self.low, self.high, self.mean, self.squares = 0, 0, None, None, 0.0, 0.0

    def add(self, v) -> None:
        self.n += 1
        self.total += v
        if self.n == 1 or v < self.low:
            self.low = v
        if self.n == 1 or v > self.high:
            self.high = v
        off = v - self.mean
        self.mean += off / self.n
        self.squares += off * (v - self.mean)

    def values(self, none: float) -> dict:
        if not self.n:
            return dict.fromkeys(("sum", "mean", "min", "max", "std"), none)
        return {"sum": self.total, "mean": self.total / self.n, "min": self.low, "max": self.high, "std": math.sqrt(self.squares / self.n)}


class Side:
    """The packets of a flow in one direction, or in both."""

    __slots__ = ("n", "length", "gap", "ttl", "ttls", "start", "last", "parts", "tcp", "windows", "window", "flags")

    def __init__(self) -> None:
        self.n, self.length, self.gap, self.ttl, self.ttls = 0, Spread(), Spread(), 0, 0
        self.start = self.last = None
        self.parts = self.tcp = self.windows = self.window = 0
        self.flags = [0] * len(_FLAGS)

    def add(self, ts: int, length: int | None, ttl: int | None, limit: float) -> float | None:
        gap = None
        if self.last is None:
            self.start = ts
        else:
            gap = (ts - self.last) / 1e6
            self.gap.add(gap)
        if gap is None or gap > limit:
            self.parts += 1
        self.last, self.n = ts, self.n + 1
        if length is not None:
            self.length.add(length)
        if ttl is not None:
            self.ttl, self.ttls = self.ttl + ttl, self.ttls + 1
        return gap

    def add_tcp(self, flags: int, window: int | None) -> None:
        self.tcp += 1
        if window is not None:
            self.window, self.windows = self.window + window, self.windows + 1
        for k, (looked, wanted) in enumerate(_FLAGS):
            self.flags[k] += flags & looked == wanted

    def statistics(self) -> list:
        """In the order of STATISTICS."""
        v, g = self.length.values(-1), self.gap.values(-1.0)
        seconds = ((self.last - self.start) / 1e6 if self.n else 0) or 1
        per_s = float(v["sum"] / seconds) if self.length.n else -1.0
        ttl = self.ttl / self.ttls if self.ttls else -1.0
        return [v["sum"], float(v["mean"]), v["min"], v["max"], float(v["std"]), self.n, self.n / seconds, per_s, ttl, g["std"], g["min"], g["max"], g["sum"]]

    def tcp_features(self) -> list:
        return [self.window / self.windows if self.windows else -1.0, *(self.flags if self.tcp else [-1] * len(_FLAGS))]

    def subflow_averages(self) -> list:
        return [self.n / self.parts, self.length.total / self.parts if self.length.n else 0.0] if self.parts else [0.0, 0.0]


class Flow:
    """One open flow."""

    def __init__(self, head: tuple, first: int, source: tuple, limit: float) -> None:
        self.head, self.first, self.source, self.limit = head, first, source, limit
        self.both, self.fwd, self.bwd = Side(), Side(), Side()
        self.active, self.idle, self.since = Spread(), Spread(), None
        self.syn = self.synack = self.ack = None

    def add(self, forward: bool, ts: int, src: int, dst: int, length: int | None, ttl: int | None, flags: int | None, window: int | None) -> None:
        side = self.fwd if forward else self.bwd
        before = self.both.last
        gap = self.both.add(ts, length, ttl, self.limit)
        side.add(ts, length, ttl, self.limit)
        if gap is None:
            self.since = ts
        elif gap > self.limit:
            self.active.add((before - self.since) / 1e6)
            self.idle.add(gap)
            self.since = ts
        if flags is None:
            return
        side.add_tcp(flags, window)
        kind = flags & (SYN | ACK)
        if self.syn is None:
            if kind == SYN:
                self.syn = (ts, src)
        elif self.synack is None:
            if kind == SYN | ACK and dst == self.syn[1]:
                self.synack = ts
        elif self.ack is None and kind == ACK and src == self.syn[1]:
            self.ack = ts

    def handshake(self) -> list:
        if self.ack is None:
            return [-1.0] * 3
        return [(b - a) / 1e6 for a, b in ((self.syn[0], self.synack), (self.synack, self.ack), (self.syn[0], self.ack))]

    def subflow_features(self) -> list:
        """In the order of SUBFLOW. The open subflow ends with the flow."""
        out = [self.idle.n + 1]
        self.active.add((self.both.last - self.since) / 1e6)
        for times in (self.active, self.idle):
            v = times.values(0.0)
            out += [times.n, v["min"], v["max"], float(v["sum"]), v["std"], v["mean"]]
        return out + self.fwd.subflow_averages() + self.bwd.subflow_averages()

    def row(self, settings: FlowSettings) -> tuple:
        modes, (by, src, dst, src_port, dst_port, protocol) = settings.modes, self.head
        out = [*by, self.first, src_port or 0, dst_port or 0, protocol]
        if "basic" not in modes:
            out += self.both.statistics() + self.fwd.statistics() + self.bwd.statistics()
        if "with_ip_addr" in modes:
            out += [src, dst]
        if "subflows" in modes:
            out += self.subflow_features()
        if "tcp" in modes and "basic" not in modes:
            out += self.fwd.tcp_features() + self.bwd.tcp_features() + self.handshake()
        return tuple(out)


def _schema(packets: StructType, settings: FlowSettings) -> StructType:
    whole = lambda n: n.endswith(_COUNTS) or n == "n_subflows" or n.endswith("_times") or n.startswith("tcp_") and "_total_" in n
    names: list[str] = []
    if "basic" not in settings.modes:
        names += [f"{d}_{n}" for d in ("total", "fwd", "bwd") for n in STATISTICS]
    fields = [*[packets[b] for b in settings.by], StructField("flow_first", packets["pkt_idx"].dataType)]
    fields += [StructField("src_port", packets["src_port"].dataType), StructField("dest_port", packets["dst_port"].dataType), packets["protocol"]]
    fields += [StructField(n, LongType() if whole(n) else DoubleType()) for n in names]
    if "with_ip_addr" in settings.modes:
        fields += [StructField("src_ip", packets["src_ip"].dataType), StructField("dest_ip", packets["dst_ip"].dataType)]
    more = SUBFLOW * ("subflows" in settings.modes) + TCP * ("tcp" in settings.modes and "basic" not in settings.modes)
    return StructType(fields + [StructField(n, LongType() if whole(n) else DoubleType()) for n in more])


@dataclass
class Prepared(AnalyzeResult):
    settings: FlowSettings = field(default_factory=FlowSettings)


def _settings(modes: str, timeout: float, subflow: float, by: str, first_only: bool, timeout_and_fin: bool) -> FlowSettings:
    wanted = FlowSettings(frozenset(modes.split()), round(float(timeout) * 1e6), round(float(subflow) * 1e6), by=tuple(by.split()), first_only=first_only, timeout_and_fin=timeout_and_fin)
    if other := wanted.modes - MODES:
        raise ValueError(f"{NAME} has no mode {sorted(other)}: SQL expressions over its result give these")
    return wanted


class FlowFeatures:
    """modes and by: names with spaces between; timeout, subflow: seconds."""

    @staticmethod
    def analyze(packets: AnalyzeArgument, modes: AnalyzeArgument | None = None, timeout: AnalyzeArgument | None = None, subflow: AnalyzeArgument | None = None, by: AnalyzeArgument | None = None, first_only: AnalyzeArgument | None = None, timeout_and_fin: AnalyzeArgument | None = None) -> Prepared:
        if not packets.isTable:
            raise ValueError(f"{NAME} takes TABLE(packets) first")
        given = {"modes": modes, "timeout": timeout, "subflow": subflow, "by": by, "first_only": first_only, "timeout_and_fin": timeout_and_fin}
        if unclear := [n for n, a in given.items() if a is not None and (not a.isConstantExpression or a.value is None)]:
            raise ValueError(f"{unclear} must be constants")
        usual = {"modes": "", "timeout": 12.0, "subflow": 0.5, "by": "file", "first_only": False, "timeout_and_fin": False}
        settings = _settings(**{n: usual[n] if a is None else a.value for n, a in given.items()})
        length = "ip_len" if "include_header_length" in settings.modes else "l4_len"
        needed = [*settings.by, "pkt_idx", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "ttl", length, "tcp_flags", "tcp_win"]
        if lacking := [c for c in needed if c not in packets.dataType.names]:
            raise ValueError(f"packets lack {lacking}")
        by_name = [f"`{b.replace('`', '``')}`" for b in settings.by]
        end = lambda a, b: f"if(src_ip < dst_ip, coalesce({a}, 0), coalesce({b}, 0))"
        key = ["least(src_ip, dst_ip)", "greatest(src_ip, dst_ip)", end("src_port", "dst_port"), end("dst_port", "src_port"), "protocol", "if(src_ip IS NULL, pkt_idx, NULL)"]
        return Prepared(
            schema=_schema(packets.dataType, settings), partitionBy=[PartitioningColumn(k) for k in (*by_name, *key)], orderBy=[OrderingColumn("pkt_idx")],
            select=[SelectedColumn(c) for c in (*by_name, *needed[len(by_name):])], settings=settings,
        )

    def __init__(self, prepared: Prepared) -> None:
        self.settings = prepared.settings
        self.n_by, self.limit = len(self.settings.by), self.settings.subflow_us / 1e6
        self.ends = FIN | (RST if "tcp_end_on_rst" in self.settings.modes else 0)
        self.flow: Flow | None = None

    def _opens(self, ts: int, flags: int | None) -> bool:
        late = ts - self.flow.both.last > self.settings.timeout_us
        if "tcp" in self.settings.modes and flags is not None:
            return bool(flags & self.ends) or late and self.settings.timeout_and_fin
        return late

    def eval(self, packets, modes=None, timeout=None, subflow=None, by=None, first_only=None, timeout_and_fin=None) -> Iterator[tuple]:
        values = tuple(packets)
        at, ts, src, dst, src_port, dst_port, protocol, ttl, length, flags, window = values[self.n_by : self.n_by + 11]
        if src is None:
            return
        opens = self.flow is None or self._opens(ts, flags)
        if opens:
            if self.flow is not None:
                yield self.flow.row(self.settings)
            self.flow = Flow((values[: self.n_by], src, dst, src_port, dst_port, protocol), at, (src, src_port), self.limit)
        forward = opens if self.settings.first_only else (src, src_port) == self.flow.source
        self.flow.add(forward, ts, src, dst, length, ttl, flags, window)

    def terminate(self) -> Iterator[tuple]:
        if self.flow is not None:
            yield self.flow.row(self.settings)


def register(spark: SparkSession, name: str = NAME) -> None:
    """Makes the function known to the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(FlowFeatures).asDeterministic())
