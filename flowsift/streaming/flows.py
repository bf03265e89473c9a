"""Flows over a packet stream: inactivity sessions with a watermark; late packets beyond it are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_flows(packets: DataFrame, keys: list[str], timeout: str = "12 seconds", lateness: str = "1 minute", ts: str = "ts", length: str = "length") -> DataFrame:
    """A row per closed flow: keys, start, end, n_packets, n_bytes. A gap equal to the timeout stays in the flow."""
    window = F.session_window(ts, timeout)
    rows = packets.withWatermark(ts, lateness).groupBy(*keys, window.alias("w")).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n_packets"), F.sum(length).alias("n_bytes"))
    return rows.drop("w")
