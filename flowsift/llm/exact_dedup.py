"""Exact dedup with a heavy-hitter split.

Texts are equal when their bytes are equal; SHA-256 stands for them. Each task keeps a Misra-Gries
summary of its digests. Whatever occurs in over 2/(counters + 1) of all rows is certain to come
out of the summed summaries, and at most counters + 1 digests can. Those candidates are counted
exactly, and their winners, a table of at most counters + 1 rows, are broadcast so that hot groups are
settled where their rows lie. All other groups hold a small share of the rows and are shuffled.

Defined cases: null text counts as empty; a null doc_id is smaller than any other; rows that repeat both
doc_id and text are all returned and one of them is kept; extra columns are ignored, and kept by deduplicate() whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.common import free_names, quoted, stored, within, without

COUNTERS = 1023


def text_digest(text_col: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            held.update(batch.column(0).to_pylist())
            if len(held) > counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = Counter({k: v - cut for k, v in held.items() if v > cut})
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "least"])

    return run


def _best():
    """Of equal texts the row with the largest doc_id stays, of several rows the first; a null doc_id is the smallest."""
    return F.max(F.struct("doc_id", (-F.col("row")).alias("row")))


def heavy_winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """digest, keep_id, keep_row, group_size of the frequent digests; at most counters + 1 rows."""
    total = digests.count()
    least = max(2, total // (counters + 1))
    found = digests.select("digest").mapInArrow(_summaries(counters), "digest binary, least long")
    frequent = [(bytes(r[0]),) for r in found.groupBy("digest").agg(F.sum("least").alias("least")).where(F.col("least") >= least).select("digest").collect()]
    spark = digests.sparkSession
    schema = "digest binary, keep_id long, keep_row long, group_size long"
    if not frequent:
        return spark.createDataFrame([], schema)
    mine = digests.join(F.broadcast(spark.createDataFrame(frequent, "digest binary")), "digest")
    settled = mine.groupBy("digest").agg(_best().alias("b"), F.count("*").alias("group_size"))
    return spark.createDataFrame(settled.select("digest", "b.doc_id", -F.col("b.row"), "group_size").collect(), schema)


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest (binary SHA-256)."""
    # row numbers tell rows apart that agree in id and text; they are fixed once written
    digests = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    winners = F.broadcast(heavy_winners(digests, counters))
    out = ["doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest"]
    hot = digests.join(winners, "digest").select(*out)
    rest = digests.join(winners.select("digest"), "digest", "left_anti").repartition("digest")
    groups = rest.groupBy("digest").agg(_best().alias("b"), F.count("*").alias("group_size"))
    groups = groups.select("digest", F.col("b.doc_id").alias("keep_id"), (-F.col("b.row")).alias("keep_row"), "group_size")
    return hot.unionByName(rest.join(groups, "digest").select(*out))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """docs with one row of each text, all columns as they were."""
    on = free_names(docs.columns, "own_id", "own_digest")
    found = stored(assign(docs, id_col, text_col, counters).where("group_size > 1").select(F.col("doc_id").alias(on[0]), F.col("digest").alias(on[1]), "keep_id", "kept"), "groups")
    stays = F.col(on[0]).eqNullSafe(F.col("keep_id"))
    lost, twice = found.where(~stays).select(*on), found.where(stays & ~F.col("kept")).select(*on)
    left = without(docs.withColumns({on[0]: F.col(id_col).cast("long"), on[1]: text_digest(text_col)}), lost, on)
    if not twice.isEmpty():
        left = without(left, twice, on).unionByName(within(left, twice, on).dropDuplicates(on))
    return left.select(*quoted(docs.columns))
