"""Streamed FIN flows against the batch rule, with packets that arrive out of order."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from flowsift.operators import flows
from flowsift.streaming.fin_flows import streaming_fin_flows
from flowsift.streaming.flows import streaming_flows


@pytest.mark.parametrize("forget_us", [10**12, 3_600_000_000])
def test_streamed_flows_equal_batch_flows(spark, tmp_path, forget_us):
    rng = random.Random(5)
    at, rows = 0, []
    for i in range(600):
        at += rng.randint(0, 9_000_000) if i % 50 else 40_000_000
        rows.append((f"h{rng.randint(0, 4)}", rng.choice([6, 17]), 1_700_000_000_000_000 + at, i, rng.randint(40, 1500), rng.random() < 0.2))
    kind = "host string, protocol int, ts_us long, pkt_idx long, length long, fin boolean"
    for part in range(3):
        mine = rows[part * 200 : part * 200 + 200]
        rng.shuffle(mine)
        spark.createDataFrame(mine, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for last in (10, 20):  # moves the watermark past all flows
        spark.createDataFrame([("end", 17, rows[-1][2] + last * 3_600_000_000, 9999 + last, 1, False)], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    packets = stream.withColumns({"ts": F.timestamp_micros("ts_us"), "tcp": F.col("protocol") == 6})
    out = streaming_fin_flows(packets, ["host", "protocol"], lateness="1 hour", forget_us=forget_us)
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    assert run.awaitTermination(90)
    got = spark.read.parquet(f"{tmp_path}/out").where("host <> 'end'")
    batch = flows.sessionize(spark.createDataFrame(rows, kind), ["host", "protocol"], 12_000_000, F.col("fin"), F.col("protocol") == 6)
    want = batch.groupBy("host", "protocol", "flow_seq").agg(F.timestamp_micros(F.min("ts_us")).alias("start"), F.timestamp_micros(F.max("ts_us")).alias("end"), F.count("*").alias("n_packets"), F.sum("length").alias("n_bytes")).drop("flow_seq")
    closed, all_flows = sorted(map(tuple, got.select(*want.columns).collect())), sorted(map(tuple, want.collect()))
    last = {k: max(f for f in all_flows if f[:2] == k) for k in {f[:2] for f in all_flows}}
    assert closed == [f for f in all_flows if forget_us < 10**12 or not (f[1] == 6 and f == last[f[:2]])]
    assert len(closed) > 100


def test_streamed_sessions_equal_batch_sessions(spark, tmp_path):
    """Flows that end by a pause; packets come out of order, and one that is later than the watermark is dropped."""
    rng = random.Random(6)
    at, rows = 0, []
    for i in range(300):
        at += rng.randint(0, 8_000_000) if i % 40 else 30_000_000
        rows.append((f"h{rng.randint(0, 3)}", 1_700_000_000_000_000 + at, i, rng.randint(40, 1500)))
    kind = "host string, ts_us long, pkt_idx long, length long"
    late = ("h0", rows[0][1] - 7_200_000_000, 999, 1)
    for part in (rows[:150], rows[150:], [("end", rows[-1][1] + 10 * 3_600_000_000, 1000, 1)], [late], [("end", rows[-1][1] + 20 * 3_600_000_000, 1001, 1)]):
        mine = list(part)
        rng.shuffle(mine)
        spark.createDataFrame(mine, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("ts", F.timestamp_micros("ts_us"))
    out = streaming_flows(stream, ["host"], "12 seconds", "1 hour")
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    assert run.awaitTermination(90)
    batch = flows.sessionize(spark.createDataFrame(rows, kind), ["host"], 12_000_000)
    want = batch.groupBy("host", "flow_seq").agg(F.timestamp_micros(F.min("ts_us")).alias("start"), F.timestamp_micros(F.max("ts_us")).alias("end"), F.count("*").alias("n_packets"), F.sum("length").alias("n_bytes")).drop("flow_seq")
    got = spark.read.parquet(f"{tmp_path}/out").where("host <> 'end'").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
