"""Files of labelled packets and what is told of them: label CSVs, attack statistics, JSON reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsift.functions import columns as C

#: The fields of a packet-label CSV. Rows without an attack type may end before it.
FIELDS = ["packet_id", "timestamp", "flow_id", "reverse_flow_id", "traffic_type", "attack_type"]
_SCHEMA = "packet_id string, timestamp double, flow_id string, reverse_flow_id string, traffic_type int, attack_type string"


def address(ip: Column) -> Column:
    """Dotted text of an IPv4 number."""
    return F.concat_ws(".", *[F.shiftright(ip, 8 * k).bitwiseAND(F.lit(255)).cast("string") for k in (3, 2, 1, 0)])


def packet_ids(packets: DataFrame, prefix: str = "", unassigned: bool = False) -> DataFrame:
    """packets with packet_id (prefix-ordinal), flow_id, reverse_id (null without an IPv4 packet) and the dotted source.

    unassigned: protocols that are not assigned count as one.
    """
    known = F.col("src_ip").isNotNull()
    src, dst, sport, dport = address(F.col("src_ip")), address(F.col("dst_ip")), C.port_or_zero(F.col("src_port")), C.port_or_zero(F.col("dst_port"))
    proto = C.unassigned_protocol(F.col("protocol")) if unassigned else F.col("protocol")
    name = F.lit(prefix) if prefix else F.col("file")
    return packets.select(F.concat_ws("-", name, F.col("pkt_idx").cast("string")).alias("packet_id"), "pkt_idx", "ts_us", F.when(known, C.flow_id(src, dst, sport, dport, proto)).alias("flow_id"), F.when(known, C.flow_id(dst, src, dport, sport, proto)).alias("reverse_id"), F.when(known, src).alias("src_ip"), sport.alias("src_port"))


def write_packet_labels(labelled: DataFrame, path: str) -> None:
    """labelled: packet_id, ts_us, flow_id, reverse_id, traffic_type, attack_type. A packet without an id has the id unknown."""
    ids = [F.coalesce(F.col(c), F.lit("unknown")).alias(n) for c, n in (("flow_id", "flow_id"), ("reverse_id", "reverse_flow_id"))]
    labelled.select("packet_id", (F.col("ts_us") / 1e6).alias("timestamp"), *ids, F.col("traffic_type").cast("int").alias("traffic_type"), "attack_type").write.mode("errorifexists").option("header", True).csv(path)


def read_packet_labels(spark: SparkSession, path: str) -> DataFrame:
    """The fields of FIELDS; shorter rows end in nulls. A path that does not exist is an error, told as a data set that is not preprocessed."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(_SCHEMA).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path)
        return rows.where(F.col("packet_id").isNotNull())
    except AnalysisException as e:
        raise FileNotFoundError(f"no packet labels at {path}; preprocess the data set first") from e


def capture_stats(labels: DataFrame, by: str = "pcap") -> DataFrame:
    """by, a count for each attack type (null if a capture has none), total, num_attacks, fraction_attacks. Attack types are some tens of names."""
    counts = labels.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("traffic_type") == 1).alias("num_attacks"))
    kinds = labels.where("traffic_type = 1").groupBy(by).pivot("attack_type").count()
    out = counts.join(kinds, by, "left")
    return out.select(by, *[c for c in kinds.columns if c != by], "total", "num_attacks", (F.col("num_attacks") / F.col("total")).alias("fraction_attacks"))


def write_stats(stats: DataFrame, path: str) -> None:
    """One CSV file, as a capture is one row."""
    stats.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Counts as doubles, since captures without an attack type have none; total and num_attacks are whole."""
    rows = spark.read.option("header", True).csv(path)
    kinds = {"total": "long", "num_attacks": "long"}
    return rows.select(rows.columns[0], *[F.col(f"`{c}`").cast(kinds.get(c, "double")).alias(c) for c in rows.columns[1:]])


def long_stats(stats: DataFrame, by: str = "pcap") -> DataFrame:
    """by, attack_type, n: the counts of read_stats() or capture_stats() as rows; none without a count."""
    kinds = [c for c in stats.columns if c not in (by, "total", "num_attacks", "fraction_attacks")]
    if not kinds:
        return stats.select(by, F.lit("").alias("attack_type"), F.lit(0).cast("long").alias("n")).limit(0)
    return stats.select(by, *[F.col(f"`{c}`").cast("long").alias(c) for c in kinds]).unpivot([by], kinds, "attack_type", "n").where("n is not null")


def write_report(report: DataFrame, path: str) -> None:
    """A JSON object a row."""
    report.coalesce(1).write.mode("overwrite").json(path)


def diagnostics(associated: DataFrame, most: int = 20) -> DataFrame:
    """diagnosis, count and the first packet ids of the packets that labels.associate() could not settle."""
    rows = associated.where("diagnosis is not null")
    place = F.row_number().over(Window.partitionBy("diagnosis").orderBy("ts_us", "packet_id"))
    first = rows.withColumn("place", place).where(F.col("place") <= most).groupBy("diagnosis").agg(F.array_sort(F.collect_list(F.struct("place", "packet_id"))).alias("head"))
    counts = rows.groupBy("diagnosis").agg(F.count("*").alias("count"))
    return counts.join(first, "diagnosis").select("diagnosis", "count", F.transform("head", lambda x: x["packet_id"]).alias("first"))


def report_of(rows: DataFrame) -> list[dict]:
    """The objects of a small report."""
    return [json.loads(r) for r in rows.toJSON().collect()]
