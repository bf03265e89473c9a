"""Documents to packed training sequences: each stage works on what its predecessor kept.

Defined cases: stages but the last return all columns of their input as they were, whatever their names; null texts count as empty and null
ids as ids; rows that repeat id and text become one at exact dedup; empty tables stay empty; without labels no document is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowsift.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from flowsift.llm.common import discard_stored, marked, stored


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("exact dedup", _exact_dedup),
    ("simhash near-dedup", _near_dedup),
    ("benchmark decontamination", _decontamination),
    ("best-fit packing", _packing),
]

#: Fingerprints, automata and packing have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = marked()
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        discard_stored(before, keep_last=True)
    return docs
