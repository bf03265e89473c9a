"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.common import stored


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("hi != lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: hi, lo (long). Returns node, root (the smallest node of its component) for all nodes of edges.

    Rounds go on until one changes nothing; each is written to the shared folder, so that neither lineage nor lost executors
    make it start over. No edges give no rows; edges of a node with itself are ignored; repeated edges count once; nulls are not allowed.
    """
    now, seen = stored(_tidy(edges), "edges"), None
    if now.isEmpty():
        return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    while True:
        both = now.select(F.col("hi").alias("x"), F.col("lo").alias("y")).unionAll(now.select(F.col("lo").alias("x"), F.col("hi").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = _tidy(both.where("y > x").join(least, "x").select(F.col("y").alias("hi"), F.col("m").alias("lo")))
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo")
        now = stored(_tidy(small), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
