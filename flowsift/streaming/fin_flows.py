"""Flows over a packet stream whose TCP flows end by FIN, as keyed state with event-time timers.

Of each key, the state has the packets that wait for the watermark, in a map by slices of time, and the open flow as a value. A batch reads and writes the slices of its own packets
alone; a slice is read again once, when the watermark has passed it. So a batch costs what it brings, however many packets wait.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

#: Microseconds of a slice of waiting packets.
SLICE = 10_000_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_FLOW = StructType([StructField(n, LongType()) for n in ("start", "end", "n_packets", "n_bytes")] + [StructField("tcp", BooleanType())])
_WAITING = StructType([StructField("packets", ArrayType(ArrayType(LongType())))])


class FinFlows(StatefulProcessor):
    def __init__(self, keys: list[str], timeout_us: int, forget_us: int, timeout_and_fin: bool) -> None:
        self.keys, self.timeout_us, self.forget_us, self.timeout_and_fin = keys, timeout_us, forget_us, timeout_and_fin

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", StructType([StructField("slice", LongType())]), _WAITING)
        self.flow = handle.getValueState("flow", _FLOW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new: dict[int, list] = {}
        for frame in rows:
            for us, place, length, fin, tcp in frame[["us", "pkt_idx", "length", "fin", "tcp"]].itertuples(index=False):
                new.setdefault(int(us) // SLICE, []).append([int(us), int(place), int(length), int(fin), int(tcp)])
        for part, packets in new.items():
            held = self.waiting.containsKey((part,))
            if not held:  # a slice is over when the watermark is beyond its last microsecond
                self.handle.registerTimer((part + 1) * SLICE // 1000 + 1)
            self.waiting.updateValue((part,), ([*(map(list, self.waiting.getValue((part,))[0]) if held else []), *packets],))
        yield pd.DataFrame()

    def _limit(self, tcp: bool) -> int:
        return self.forget_us if tcp and not self.timeout_and_fin else self.timeout_us

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        ready = sorted(p[0] for p in self.waiting.keys() if (p[0] + 1) * SLICE <= mark)
        flow = list(self.flow.get()) if self.flow.exists() else None
        closed, before = [], flow and tuple(flow)
        for part in ready:
            for us, _, length, fin, tcp in sorted(map(list, self.waiting.getValue((part,))[0])):
                if flow:
                    gone = us - flow[1] > self.timeout_us
                    if (fin or gone and self.timeout_and_fin or us - flow[1] > self.forget_us) if tcp else gone:
                        closed.append(flow)
                        flow = None
                flow = [flow[0], us, flow[2] + 1, flow[3] + length, bool(tcp)] if flow else [us, us, 1, length, bool(tcp)]
            self.waiting.removeKey((part,))
        # nothing that waits is older than mark - SLICE
        if flow and flow[1] + self._limit(flow[4]) < mark // SLICE * SLICE:
            closed.append(flow)
            flow = None
        if flow is None:
            self.flow.clear()
        elif tuple(flow) != before:
            self.flow.update(tuple(flow))
            self.handle.registerTimer((flow[1] + self._limit(flow[4])) // SLICE * SLICE // 1000 + 2 * SLICE // 1000 + 1)
        yield pd.DataFrame([(*key, *f[:4]) for f in closed], columns=[*self.keys, "start", "end", "n_packets", "n_bytes"]) if closed else pd.DataFrame()

    def close(self) -> None:
        pass


def streaming_fin_flows(packets: DataFrame, keys: list[str], timeout_us: int = 12_000_000, forget_us: int = 3_600_000_000, timeout_and_fin: bool = False, lateness: str = "1 minute") -> DataFrame:
    """A row per closed flow: keys, start, end, n_packets, n_bytes; the boundaries are those of flows.sessionize.

    packets: keys (the protocol among them), ts timestamp, pkt_idx long, length long, fin boolean, tcp boolean. Packets wait until the
    watermark has passed their slice and are then taken by time and pkt_idx, so that the order of arrival does not matter;
    later ones are dropped. A TCP flow that ends by FIN alone is closed after forget_us without packets, which bounds
    the state; null flags count as false, null lengths as 0. Null times are ignored. The session gets the state store that lists, maps and timers need.
    """
    packets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    typed = dict(packets.dtypes)
    rows = packets.where(F.col("ts").isNotNull()).withWatermark("ts", lateness).select(*keys, "ts", F.unix_micros("ts").alias("us"), "pkt_idx", F.coalesce("length", F.lit(0)).cast("long").alias("length"), F.coalesce("fin", F.lit(False)).alias("fin"), F.coalesce("tcp", F.lit(False)).alias("tcp"))
    schema = ", ".join([*(f"`{k}` {typed[k]}" for k in keys), "start long, end long, n_packets long, n_bytes long"])
    out = rows.groupBy(*keys).transformWithStateInPandas(FinFlows(keys, timeout_us, forget_us, timeout_and_fin), schema, "append", "eventTime")
    return out.withColumns({"start": F.timestamp_micros("start"), "end": F.timestamp_micros("end")})
