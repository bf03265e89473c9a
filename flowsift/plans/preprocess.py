"""From captures and labelled flows to packet labels, attack statistics and a validation of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.functions import columns as C
from flowsift.operators import labels as L
from flowsift.sources import packet_labels, pcap
from flowsift.sources.datasets import DATASETS, label_file


def label_capture(spark: SparkSession, dataset: str, folder: str, capture: str, flows: DataFrame, modify_timestamps: str = "none", use_end: bool = False) -> DataFrame:
    """The packets of one capture with labels and diagnoses; modify_timestamps: none, ceil or round to whole seconds, before flows are sought."""
    known = DATASETS[dataset]
    packets = packet_labels.packet_ids(pcap.read_pcap(spark, f"{folder}/{capture}", linklayer=known.link_layer), capture, known.unassigned)
    at = (C.whole_seconds(F.col("ts_us") / 1e6, modify_timestamps) * 1e6).cast("long") if modify_timestamps != "none" else F.col("ts_us")
    found = L.associate(packets.withColumns({"own_us": F.col("ts_us"), "ts_us": at}), flows, use_end)
    return found.withColumn("ts_us", F.col("own_us")).drop("own_us")


def all_labels(spark: SparkSession, dataset: str, folder: str, captures: list[str]) -> DataFrame:
    """The written labels of captures, with the column pcap."""
    read = [packet_labels.read_packet_labels(spark, label_file(folder, c, dataset)).withColumn("pcap", F.lit(c)) for c in captures]
    out = read[0]
    for more in read[1:]:
        out = out.unionByName(more)
    return out


def expected_packets(flows: DataFrame) -> DataFrame:
    """info, flows and n (packets) of labelled attacks."""
    return flows.where("traffic_type = 1").groupBy(F.col("info").alias("attack_type")).agg(F.count("*").alias("flows"), F.sum(F.col("src_packets") + F.col("dest_packets")).alias("n"))


def validation(flows: DataFrame, stats: DataFrame) -> DataFrame:
    """attack_type (total for all), expected_flows, expected, actual, difference and error of attack packets, from labelled flows and written statistics."""
    expected = expected_packets(flows)
    actual = packet_labels.long_stats(stats).groupBy("attack_type").agg(F.sum("n").alias("n"))
    both = L.expected_actual(expected, actual, "attack_type").join(expected.select("attack_type", "flows"), "attack_type", "left").withColumn("expected_flows", F.coalesce("flows", F.lit(0)))
    total = both.agg(F.lit("total").alias("attack_type"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("expected", "actual", "expected_flows")])
    total = total.withColumns({"difference": F.col("actual") - F.col("expected"), "error": F.when(F.col("expected") == 0, 0.0).otherwise(F.abs(F.col("expected") - F.col("actual")) / F.nullif("expected", F.lit(0)))})
    names = ["attack_type", "expected_flows", "expected", "actual", "difference", "error"]
    return both.select(*names).unionByName(total.select(*names))


def preprocess(spark: SparkSession, dataset: str, folder: str, captures: list[str] | None = None, only_stats: bool = False, only_validate: bool = False, modify_timestamps: str = "none", use_end: bool = False) -> DataFrame:
    """Labels every packet, writes the label files, preprocessing_report, attack_stats.csv and validation_report below folder; returns the validation.

    only_stats leaves the labelling out, only_validate also the statistics. captures: those of the data set that are there, all by default.
    """
    known = DATASETS[dataset]
    captures = captures or known.captures()
    if not only_stats and not only_validate:
        told = None
        for capture in captures:
            labelled = label_capture(spark, dataset, folder, capture, known.flows(spark, folder, capture), modify_timestamps, use_end).persist()
            packet_labels.write_packet_labels(labelled, label_file(folder, capture, dataset))
            one = packet_labels.diagnostics(labelled).withColumn("pcap", F.lit(capture))
            rows = one.collect()
            told = [*(told or []), *rows]
            labelled.unpersist()
        schema = "diagnosis string, count long, first array<string>, pcap string"
        packet_labels.write_report(spark.createDataFrame(told or [], schema), f"{folder}/preprocessing_report")
    if not only_validate:
        packet_labels.write_stats(packet_labels.capture_stats(all_labels(spark, dataset, folder, captures)), f"{folder}/attack_stats.csv")
    stats = packet_labels.read_stats(spark, f"{folder}/attack_stats.csv")
    if dataset == "cic-ids-2017":
        flows = known.flows(spark, folder, captures[0])
        for capture in captures[1:]:
            flows = flows.unionByName(known.flows(spark, folder, capture))
    else:
        flows = known.flows(spark, folder, captures[0]).where("flow_id is not null")
    report = validation(flows, stats)
    packet_labels.write_report(report, f"{folder}/validation_report")
    return report
