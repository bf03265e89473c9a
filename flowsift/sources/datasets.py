"""Readers of two public intrusion data sets: their captures, label files, subsets and the sequences that training and tests read."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.functions import columns as C
from flowsift.operators import labels as L
from flowsift.sources import label_csv, packet_labels, pcap

Ranges = list[tuple[int, int | str]]
WHOLE: Ranges = [(0, "end")]

#: The five days of the one data set, with their captures, label files and subsets.
DAYS = {
    "monday": "PCAPs/Monday-WorkingHours.pcap",
    "tuesday": "PCAPs/Tuesday-WorkingHours.pcap",
    "wednesday": "PCAPs/Wednesday-WorkingHours.pcap",
    "thursday": "PCAPs/Thursday-WorkingHours.pcap",
    "friday": "PCAPs/Friday-WorkingHours.pcap",
}
DAY_LABELS = {
    "monday": ["labels/Monday-WorkingHours.pcap_ISCX.csv"],
    "tuesday": ["labels/Tuesday-WorkingHours.pcap_ISCX.csv"],
    "wednesday": ["labels/Wednesday-workingHours.pcap_ISCX.csv"],
    "thursday": ["labels/Thursday-WorkingHours-Morning-WebAttacks.pcap_ISCX.csv", "labels/Thursday-WorkingHours-Afternoon-Infilteration.pcap_ISCX.csv"],
    "friday": ["labels/Friday-WorkingHours-Morning.pcap_ISCX.csv", "labels/Friday-WorkingHours-Afternoon-DDos.pcap_ISCX.csv", "labels/Friday-WorkingHours-Afternoon-PortScan.pcap_ISCX.csv"],
}
DAY_SUBSETS: dict[str, tuple[dict[str, Ranges], dict[str, Ranges]]] = {
    "small": ({"monday": [(0, 10_000), (50_000, 1_500_000), (10_000_000, "end")]}, {"friday": [(400, 5000), (50_000, 90_000), (5_000_000, "end")], "tuesday": [(999, 99_999)]}),
    "tiny": ({"monday": [(0, 100), (400, 1000)], "thursday": [(0, 400)]}, {"thursday": [(999, 12_000)], "wednesday": [(99, 1000), (2099, 10_000)]}),
}
#: The folders and numbers of captures of the other data set, its flow files and named subsets (places in the first or second folder).
FOLDERS = {"01": 53, "02": 27}
FLOW_FILES = [f"UNSW-NB15 - CSV Files/UNSW-NB15_{i}.csv" for i in range(1, 5)]
FEATURE_FILE = "UNSW-NB15 - CSV Files/NUSW-NB15_features.csv"
DEFAULT_TRAIN = ("01", 23, 27)
TRAIN_SETS = {"A": ("01", 10, 31), "B": ("01", 32, 53), "full": ("01", 10, 53)}
TEST_SETS = {"a": ("01", 1, 9), "b": ("02", 1, 14), "c": ("02", 15, 27)}


@dataclass(frozen=True)
class Subset:
    """Captures (paths below the data set's folder) with the ranges of packets to train on and to test."""

    dataset: str
    name: str
    train_name: str
    test_name: str
    train: dict[str, Ranges]
    test: dict[str, Ranges]


def day_subset(name: str = "default") -> Subset:
    """default, small, tiny or the day of the attacks; training is on Monday unless the subset says otherwise."""
    if name in DAY_SUBSETS:
        train, test = DAY_SUBSETS[name]
        titles = name, name
    elif name == "default" or name in DAYS and name != "monday":
        days = [d for d in DAYS if d != "monday"] if name == "default" else [name]
        train, test = {"monday": WHOLE}, {d: WHOLE for d in days}
        titles = "Monday", ", ".join(d.capitalize() for d in days) if name == "default" else name
    else:
        raise ValueError(f"{name} is no subset")
    return Subset("cic-ids-2017", name, *titles, {DAYS[d]: r for d, r in train.items()}, {DAYS[d]: r for d, r in test.items()})


def all_captures() -> list[str]:
    return [f"{folder}/{i}.pcap" for folder, n in FOLDERS.items() for i in range(1, n + 1)]


def _span(of: tuple[str, int, int]) -> list[str]:
    folder, first, last = of
    return [f"{folder}/{i}.pcap" for i in range(first, last + 1)]


def numbered_subset(name: str = "default", existing: list[str] | None = None) -> Subset:
    """default or all, tiny, or train/test: each a named set or ranges like 1-10,14 of all captures, in the order of the ranges.

    existing: the captures that are there, which default takes.
    """
    train_name, _, test_name = name.partition("/")
    if name in ("default", "all"):
        train = _span(DEFAULT_TRAIN)
        there = all_captures() if existing is None else [c for c in all_captures() if c in set(existing)]
        return Subset("unsw-nb15", name, name, name, {c: WHOLE for c in there if c in train}, {c: WHOLE for c in there if c not in train})
    if name == "tiny":
        return Subset("unsw-nb15", name, name, name, {"01/1.pcap": [(0, 20)]}, {"01/1.pcap": [(21, 30)]})
    if not train_name or not test_name:
        raise ValueError(f"{name} is no subset: both of train/test are needed")
    pick = lambda part, named: _span(named[part]) if part in named else pcap.select_files(all_captures(), part.split(","))
    return Subset("unsw-nb15", name, train_name, test_name, {c: WHOLE for c in pick(train_name, TRAIN_SETS)}, {c: WHOLE for c in pick(test_name, TEST_SETS)})


@dataclass(frozen=True)
class Traffic:
    """Packets (traffic_name, packet_id and the decoded columns), their labels (packet_id, traffic_type, attack_type) and parts (part_name, packet_id)."""

    packets: DataFrame
    labels: DataFrame
    parts: DataFrame


def label_file(folder: str, capture: str, dataset: str) -> str:
    """Where the packet labels of a capture are: beside it, or for the days in the folder itself."""
    return f"{folder}/{capture.rsplit('/', 1)[-1]}_packet_labels.csv" if dataset == "cic-ids-2017" else f"{folder}/{capture}_packet_labels.csv"


def _sequence(spark: SparkSession, folder: str, subset: Subset, capture: str, ranges: Ranges, name: str) -> tuple[DataFrame, DataFrame]:
    packets = pcap.subset(pcap.read_pcap(spark, f"{folder}/{capture}"), ranges).withColumns({"traffic_name": F.lit(name), "packet_id": F.concat_ws("-", F.lit(capture), F.col("pkt_idx").cast("string"))})
    found = packet_labels.read_packet_labels(spark, label_file(folder, capture, subset.dataset)).withColumn("traffic_name", F.lit(name))
    return packets, found


def read_traffic(spark: SparkSession, folder: str, subset: Subset, training: bool, drop_attacks: bool = False) -> Traffic:
    """The sequences of a subset as one set of tables. Training sequences are one, with the part all alone; tests have a part for each attack type.

    drop_attacks leaves attack packets out of the training sequence, which the data sets' captures may hold.
    """
    chosen = subset.train if training else subset.test
    if not chosen:
        raise ValueError(f"subset {subset.name} has no captures")
    joined = f"benign@{subset.dataset}:{','.join(sorted(c.removesuffix('.pcap') for c in chosen))}"
    made = [_sequence(spark, folder, subset, c, r, joined if training else f"{c}@{subset.dataset}:unknown") for c, r in chosen.items()]
    packets, found = (reduce(DataFrame.unionByName, frames) for frames in zip(*made))
    if training:
        if drop_attacks:
            packets = packets.join(found.where("traffic_type = 1").select("packet_id"), "packet_id", "left_anti")
        return Traffic(packets, found, found.select("traffic_name", F.lit("all").alias("part_name"), "packet_id"))
    parts = [L.parts(one, "packet_id", "attack_type", F.col("traffic_type") == 0).withColumn("traffic_name", F.lit(f"{c}@{subset.dataset}:unknown")) for c, (_, one) in zip(chosen, made)]
    return Traffic(packets, found, reduce(DataFrame.unionByName, parts))


def dummy_traffic(spark: SparkSession, training: bool) -> Traffic:
    """Made-up sequences: 3,000 benign packets to train on; ten tests of 1,000 of which 100 i are benign."""
    if training:
        rows = spark.range(3000).select(F.lit("dummy/train").alias("traffic_name"), F.col("id").cast("string").alias("packet_id"), F.col("id").alias("pkt_idx"), F.lit(0).alias("traffic_type"))
    else:
        rows = spark.range(10_000).select(F.format_string("dummy/test-%d", F.expr("id div 1000")).alias("traffic_name"), F.format_string("%d-%d", F.expr("id div 1000"), F.col("id") % 1000).alias("packet_id"), (F.col("id") % 1000).alias("pkt_idx"), (F.col("id") % 1000 >= 100 * F.expr("id div 1000")).cast("int").alias("traffic_type"))
    packets = rows.select("traffic_name", "packet_id", "pkt_idx", F.lit(420_000_000).cast("long").alias("ts_us"))
    found = rows.select("traffic_name", "packet_id", "traffic_type", F.when(F.col("traffic_type") == 1, "attack").alias("attack_type"))
    return Traffic(packets, found, found.select("traffic_name", F.lit("all").alias("part_name"), "packet_id"))


def numbered_flows(rows: DataFrame) -> DataFrame:
    """Flow labels (label_csv.flow_labels) in the form that labels.associate() takes; flows of unknown protocols have a null id."""
    proto = C.unassigned_protocol(C.protocol_number(F.col("proto")))
    port = lambda c: F.coalesce(F.expr(f"try_cast({c} as int)"), F.lit(0))
    sides = F.trim("srcip"), F.trim("dstip"), port("sport"), port("dsport")
    known = lambda c: F.when(proto.isNotNull(), c)
    seconds = lambda c: (F.col(c).cast("double") * 1_000_000).cast("long")
    return rows.select(
        known(C.flow_id(*sides, proto)).alias("flow_id"), known(C.flow_id(sides[1], sides[0], sides[3], sides[2], proto)).alias("reverse_id"), seconds("Stime").alias("start_us"), seconds("Ltime").alias("end_us"),
        F.col("attack_cat").alias("info"), "traffic_type", sides[0].alias("src_ip"), sides[2].alias("src_port"), F.col("Spkts").cast("long").alias("src_packets"), F.col("Dpkts").cast("long").alias("dest_packets"),
    )


def day_flows(rows: DataFrame, business_hours: bool = False) -> DataFrame:
    """Day labels (label_csv.day_labels) in the form that labels.associate() takes; they have no end time."""
    start = F.unix_micros(C.cic_timestamp(F.col("Timestamp"), business_hours=business_hours))
    return rows.select(
        F.col("`Flow ID`").alias("flow_id"), C.reverse_flow_id(F.col("`Flow ID`")).alias("reverse_id"), start.alias("start_us"), F.lit(None).cast("long").alias("end_us"), C.normal_info(F.col("Label")).alias("info"),
        F.when(F.trim("Label") == "BENIGN", 0).otherwise(1).alias("traffic_type"), F.col("`Source IP`").alias("src_ip"), F.col("`Source Port`").cast("int").alias("src_port"), F.col("`Total Fwd Packets`").cast("double").cast("long").alias("src_packets"), F.col("`Total Backward Packets`").cast("double").cast("long").alias("dest_packets"),
    )


@dataclass(frozen=True)
class Dataset:
    """What is asked of a data set by its name: subsets, captures, labelled flows of a capture and the link layer of its captures."""

    subset: Callable[[str], Subset]
    captures: Callable[[], list[str]]
    flows: Callable[[SparkSession, str, str], DataFrame]
    link_layer: str
    unassigned: bool


def _numbered(spark: SparkSession, folder: str, capture: str) -> DataFrame:
    names = label_csv.column_names(spark, f"{folder}/{FEATURE_FILE}")
    return numbered_flows(label_csv.flow_labels(spark, [f"{folder}/{f}" for f in FLOW_FILES], names))


def _days(spark: SparkSession, folder: str, capture: str) -> DataFrame:
    day = next(d for d, c in DAYS.items() if c == capture)
    return day_flows(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [label_csv.day_labels(spark, [f"{folder}/{f}"]) for f in DAY_LABELS[day]]))


DATASETS = {
    "cic-ids-2017": Dataset(day_subset, lambda: list(DAYS.values()), _days, "ethernet", False),
    "unsw-nb15": Dataset(numbered_subset, all_captures, _numbered, "sll", True),
}
