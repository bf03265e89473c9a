"""Sum-of-squares packing of documents into training sequences.

A document is cut into pieces of `limit` tokens only if it is longer; its first piece takes the remainder. Full
pieces are sequences of their own. The others are dealt at random, by a hash, to groups of about GROUP_ROWS pieces; each task packs one group.
Pieces are placed from long to short. With N(g) the number of open bins with a gap of g, a piece goes to the gap that makes the sum
of N(g)^2 over open gaps smallest; a new bin is opened only if it fits nowhere, since the whole group is known beforehand.

Defined cases: null text counts as empty and is one piece with the end token alone; a null doc_id is kept; repeated rows are
packed as separate documents; sequence ids are unique over all groups; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.common import stored
from flowsift.llm.tokens import PartEncoder, vocabulary_path

LIMIT, END = 1024, 2
GROUP_ROWS = 16_384
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, limit: int = LIMIT, end: int = END, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, an array) of every piece."""
    path = vocabulary or vocabulary_path()
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PartEncoder(path)
        for batch in batches:
            out: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.whole(text.as_py() or "") + last
                n = len(ids) // 4
                first = n - (n - 1) // limit * limit
                edges = [0, *range(first, n + 1, limit)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    out.append((i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), ids[4 * a : 4 * b]))
            columns = list(zip(*out)) if out else [[]] * 6
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[5]], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, _PIECES + ", ids array<int>" * with_ids)


def place(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """bin and offset of each piece, in the order given (long to short)."""
    count = np.zeros(limit + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(limit + 1)]
    bins, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for at, size in enumerate(lengths.tolist()):
        before = count[size:]
        gap = -1
        if before.any():
            change = 2 * (count[: limit + 1 - size] - before) + 2
            change[0] = 1 - 2 * before[0]  # a full bin leaves no gap to count
            change[before == 0] = 4 * len(lengths)
            gap = size + int(change.argmin())
            where = open_[gap].pop()
            count[gap] -= 1
        else:
            gap, where = limit, made
            made += 1
        bins[at], offsets[at] = where, limit - gap
        if gap > size:
            open_[gap - size].append(where)
            count[gap - size] += 1
    return bins, offsets


def pack(docs: DataFrame, limit: int = LIMIT, end: int = END, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The pieces of cut() with sequence_id and offset."""
    pieces = stored(cut(docs, limit, end, vocabulary, id_col, text_col, with_ids), "pieces")
    groups = max(1, -(-pieces.where(F.col("length") < limit).count() // group_rows))
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        part = TaskContext.get().partitionId()
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]
        table = table.sort_by(order)
        bins, offsets = place(table.column("length").to_numpy(), limit)
        table = table.append_column("sequence_id", pa.array(bins + (part << 36))).append_column("offset", pa.array(offsets))
        yield from table.to_batches()

    schema = f"{', '.join(f'{n} {t}' for n, t in pieces.dtypes)}, sequence_id long, offset long"
    full = pieces.where(F.col("length") == limit)
    full = full.select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # row numbers deal rows that agree in id and text to different groups; they are fixed, since the pieces are written
    rest = pieces.withColumn("g", F.monotonically_increasing_id()).where(F.col("length") < limit).withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32", "g"), F.lit(groups)))
    rest = rest.repartition(groups, "g").drop("g").mapInArrow(run, schema)
    return full.unionByName(rest)
