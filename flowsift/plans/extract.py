"""From captures straight to a CSV of flow features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.operators import extractors, transformers
from flowsift.operators.extractors import FlowSettings
from flowsift.sources import pcap


def extract_flows(spark: SparkSession, captures: str, out: str | None = None, extractor: str = "flow_extractor", settings: FlowSettings = FlowSettings(), one_hot: bool = False, clustering: float = 0.0, smoothing: float = 1e-4) -> DataFrame:
    """The features of the flows in a capture, or in all of a folder, one row a flow in order; written as CSV with a header if out is given.

    payl_flows is fitted on the captures themselves. one_hot turns categorical features into an indicator for each of their values.
    """
    packets = pcap.read_pcap(spark, captures)
    if extractor == "payl_flows":
        rows = extractors.payl_flows(packets, extractors.fit_payl(packets, settings, clustering), settings, smoothing)
    else:
        rows = {"flow_extractor": extractors.flow_features, "flows_payload": extractors.payload_flows}[extractor](packets, settings)
    names = extractors.feature_names(rows, settings)
    for name in [n for n in names if one_hot and extractors.feature_type(n) == "categorical"]:
        rows = transformers.one_hot(rows, name, transformers.vocabulary(rows, name))
    rows = rows.orderBy(*settings.by, "flow_idx")
    if out:
        rows.select(*[F.col(f"`{n}`") for n in extractors.feature_names(rows, settings)]).write.mode("errorifexists").option("header", True).csv(out)
    return rows
