"""Labelled flow CSVs of both data sets: feature dictionaries, flow labels and day labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from flowsift.functions import columns as C

#: Tried in this order; ISO-8859-1 decodes any bytes and comes last.
ENCODINGS = ("UTF-8", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32", "ISO-8859-1")
#: What windows-1252 has at 0x80 to 0x9F, where ISO-8859-1 has control characters; its five gaps stay as they are.
_C1 = "".join(map(chr, (0x80, *range(0x82, 0x8D), 0x8E, *range(0x91, 0x9D), 0x9E, 0x9F)))
_WINDOWS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def find_encoding(spark: SparkSession, path: str, looks_right: Callable[[list[Row]], bool], rows: int = 3) -> str | None:
    """The first encoding whose first rows pass looks_right; only these rows are read."""
    for encoding in ENCODINGS:
        head = spark.read.option("encoding", encoding).csv(path).limit(rows).collect()
        if head and looks_right(head):
            return encoding
    return None


def starts_with_address(head: list[Row]) -> bool:
    """Whether the first cell is a dotted quad."""
    octets = (head[0][0] or "").split(".")
    return len(octets) == 4 and all(o.isascii() and o.isdigit() and len(o) < 4 for o in octets)


def column_names(spark: SparkSession, path: str, field: str = "Name") -> list[str]:
    """The feature names that a dictionary file lists, in its order; such files have some tens of lines."""
    head = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return [r[0].strip() for r in head.select(field).collect() if r[0]]


def _windows_text(text: Column) -> Column:
    return F.translate(text, _C1, _WINDOWS)


def flow_labels(spark: SparkSession, paths: list[str], names: list[str], label: str = "Label", category: str = "attack_cat", encoding: str | None = None) -> DataFrame:
    """Rows of files without a header, with traffic_type added and the category in its normal form.

    Empty rows go. A missing category is empty text, and the plural backdoors counts as backdoor. Without an encoding, that of the first
    file is sought, UTF-8 if none fits.
    """
    encoding = encoding or find_encoding(spark, paths[0], starts_with_address) or "UTF-8"
    schema = ", ".join(f"`{n}` {'int' if n == label else 'string'}" for n in names)
    rows = spark.read.schema(schema).option("encoding", encoding).csv(paths).dropna("all")
    info = C.normal_info(F.col(f"`{category}`"))
    return rows.withColumns({category: F.when(info == "backdoors", "backdoor").otherwise(info), "traffic_type": C.traffic_type(F.col(f"`{label}`"))})


def day_labels(spark: SparkSession, paths: list[str], key: str = "Flow ID", label: str = "Label") -> DataFrame:
    """Rows of files with a header in windows-1252, names stripped, labels in upper case; rows without anything but a key go."""
    rows = spark.read.option("header", True).option("encoding", "ISO-8859-1").csv(paths)
    rows = rows.toDF(*[n.strip() for n in rows.columns])
    rows = rows.dropna("all", subset=[f"`{n}`" for n in rows.columns if n != key])
    return rows.withColumn(label, F.upper(_windows_text(F.col(f"`{label}`"))))


def attacks_per_protocol(flows: DataFrame, protocol: str = "proto") -> DataFrame:
    """Labelled attack flows of each protocol."""
    return flows.where("traffic_type = 1").groupBy(protocol).agg(F.count("*").alias("n"))
