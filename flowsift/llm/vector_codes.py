"""Product codes of vectors with annular norm pruning.

A vector of integers is cut into equal parts and each part is named by the nearest entry of its codebook. The entries of a codebook lie in the order of
their norms. An entry whose norm differs from a part's norm by more than some known distance cannot be nearer than that (the triangle inequality), so
a part is measured against the entries beside it in the order of norms, and then against the annulus that this distance leaves, found by binary
search, both ends included, so that ties are seen too. Codebooks start from the rows of the smallest ids and are refined by a fixed number of
rounds; a round is one scan, in which each task adds up its own rows.

Defined cases: rows whose vector is null, empty, or holds a null or non-finite component are dropped, and so are vectors that are not as long as that of
the smallest kept id; that length must be a multiple of the number of parts. Null ids come after all others and repeated ids lie in the order
of their vectors; repeated rows are coded each. Fewer rows than entries give as many entries as rows; entries beyond are not made. A component counts as
LARGEST in size at most, so that no sum of squares leaves 64 bits. No rows give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.common import BROADCAST_ROWS, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 27
PAIRS_AT_ONCE = 1_000_000


class Codebook:
    """The entries (rows) of one part in the order of their norms."""

    def __init__(self, entries: np.ndarray) -> None:
        norms = np.sqrt((entries * entries).sum(axis=1).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order]

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, the lowest of several, and its squared distance, of each row."""
        index, best = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        step = max(1, PAIRS_AT_ONCE // len(self.norms))
        for at in range(0, len(rows), step):
            index[at : at + step], best[at : at + step] = self._annulus(rows[at : at + step])
        return index, best

    def _annulus(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norms = np.sqrt((rows * rows).sum(axis=1).astype(np.float64))
        above = np.searchsorted(self.norms, norms)
        known = None
        for beside in (above - 1, above):
            apart = rows - self.entries[np.clip(beside, 0, len(self.norms) - 1)]
            apart = (apart * apart).sum(axis=1)
            known = apart if known is None else np.minimum(known, apart)
        reach = np.sqrt(known.astype(np.float64))
        reach += 1e-9 + 1e-12 * (reach + norms)  # roots are rounded
        low, high = np.searchsorted(self.norms, norms - reach, "left"), np.searchsorted(self.norms, norms + reach, "right")
        size = high - low
        first = np.cumsum(size) - size
        row = np.repeat(np.arange(len(rows)), size)
        entry = low[row] + np.arange(len(row)) - first[row]
        apart = rows[row] - self.entries[entry]
        apart = (apart * apart).sum(axis=1)
        best = np.minimum.reduceat(apart, first)
        return np.minimum.reduceat(np.where(apart == best[row], self.order[entry], len(self.norms)), first), best


def integers(values: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * values.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64)


def _parts(column: pa.Array, books: list[np.ndarray]) -> np.ndarray:
    """The integer vectors of a batch, as rows, parts and places."""
    return integers(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), len(books), -1)


def _sums(books: list[np.ndarray]):
    """Number and sums, by part, entry and place, of the rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in books]
        shape = (len(books), *books[0].shape)
        count, total = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for batch in batches:
            rows = _parts(batch.column(1), books)
            for p, book in enumerate(own):
                index = book.nearest(rows[:, p])[0]
                count[p] += np.bincount(index, minlength=shape[1])[:, None]
                np.add.at(total[p], index, rows[:, p])
        place = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(count.ravel()[place]), pa.array(total.ravel()[place])], ["place", "n", "total"])

    return run


def _codes(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Codebook(b) for b in books]
        for batch in batches:
            rows = _parts(batch.column(1), books)
            index, apart = zip(*(book.nearest(rows[:, p]) for p, book in enumerate(own)))
            codes = [r.tobytes().hex() for r in np.stack(index, axis=1).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(codes, pa.string()), pa.array(np.sum(apart, axis=0))], ["vec_id", "label", "code", "error"])

    return run


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    wrong = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where((F.size("v") > 0) & ~wrong)


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part (entries and places) after the rounds. rows: those of _kept(), of one length."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v").asc()]
    first = rows.orderBy(*order).limit(entries).select("v").collect()  # a codebook's size, whatever the table's
    start = integers(np.array([r["v"] for r in first])).reshape(len(first), parts, -1)
    books = [np.ascontiguousarray(start[:, p]) for p in range(parts)]
    for _ in range(rounds):
        sums = rows.mapInArrow(_sums(books), "place long, n long, total long")
        sums = sums.groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        flat = np.stack(books).ravel()
        for r in sums.collect():  # one row for each number of the codebooks at most
            flat[r["place"]] = int(r["total"]) // r["n"]
        books = list(flat.reshape(parts, len(first), -1))
    return books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for x in np.stack(books).ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances summed over parts), label_error (summed over equal labels, nulls together) and codebooks_sha256 of every kept row."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so a codebook has 1 to 256 entries")
    rows = _kept(vectors, id_col, vector_col, label_col)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v").alias("n")).first()
    length = first["n"] if first else parts
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("v") == length)
    books = fit(rows, parts, entries, rounds) if first else []
    label = rows.schema["label"].dataType.simpleString()
    coded = rows.mapInArrow(_codes(books), f"vec_id long, label {label}, code string, error long") if first else rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    coded = stored(coded, "codes")
    errors = stored(coded.groupBy(F.col("label").alias("own_label")).agg(F.sum("error").alias("label_error")), "label_errors")
    errors = F.broadcast(errors) if errors.count() <= BROADCAST_ROWS else errors
    joined = coded.join(errors, F.col("label").eqNullSafe(F.col("own_label"))).drop("own_label")
    return joined.withColumn("codebooks_sha256", F.lit(books_digest(books) if first else ""))
