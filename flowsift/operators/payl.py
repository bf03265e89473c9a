"""Payload byte distributions: histograms, centroids by protocol, port and length, nearest length, distance, clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.functions.columns import l1_distance

KEY = ["protocol", "port", "length"]
#: Payloads, and their bytes, that are counted at a time; keys whose sums a task holds; rows that meet a centroid in one part.
SLICE_ROWS, SLICE_BYTES, HELD_KEYS, PART_ROWS = 512, 1 << 20, 4096, 250_000


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last place, the byte counts (rows x 256) and the lengths of some payloads at a time; null counts as empty."""
    data = (pc.fill_null(column, b"") if column.null_count else column).cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1] if len(data) else np.zeros(1, np.int64)
    flat = np.frombuffer(data.buffers()[2], np.uint8) if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    a = 0
    while a < len(data):
        b = min(len(data), a + SLICE_ROWS, max(a + 1, int(np.searchsorted(ends, ends[a] + SLICE_BYTES, "right")) - 1))
        size = np.diff(ends[a : b + 1])
        own = flat[ends[a] : ends[b]]
        if b == a + 1:  # it may be long
            counts = sum((np.bincount(own[k : k + SLICE_BYTES], minlength=256) for k in range(0, len(own), SLICE_BYTES)), np.zeros(256, np.int64))[None]
        else:
            counts = np.bincount(np.repeat(np.arange(b - a) * 256, size) + own, minlength=256 * (b - a)).reshape(-1, 256)
        yield a, b, counts, size
        a = b


def _arrays(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows of 256 as an array of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(values).ravel(), kind))


def _counted(rows: DataFrame, payload: str, keep: list[str], name: str, kind: str, of) -> DataFrame:
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.select(*keep).dtypes) + f", {name} array<{kind}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, counts, size in _slices(batch.column(len(keep))):
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[: len(keep)]), _arrays(of(counts, size), pa.int64() if kind == "long" else pa.float64())], [*keep, name])

    return rows.select(*keep, F.col(payload).cast("binary")).mapInArrow(run, schema)


def _shares(counts: np.ndarray, size: np.ndarray) -> np.ndarray:
    return counts / np.maximum(size, 1)[:, None]


def byte_shares(rows: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """keep and freq, the shares of the 256 bytes of each binary payload; zeros for an empty or null one."""
    return _counted(rows, payload, keep, "freq", "double", _shares)


def byte_counts(rows: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """keep and counts, an array of 256 longs, of each binary payload; null counts as empty."""
    return _counted(rows, payload, keep, "counts", "long", lambda counts, size: counts)


def _groups(columns: list[pa.Array]) -> np.ndarray:
    """The number of each row's key among the keys of a batch; nulls are equal."""
    codes = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        own = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, codes = np.unique(codes * (own.max(initial=0) + 1) + own, return_inverse=True)
    return codes


def _merged(one: tuple, n: int, mean: np.ndarray, apart: np.ndarray) -> tuple:
    """Number, mean and summed squares from the mean of two sets of rows."""
    whole = one[0] + n
    off = mean - one[1]
    return whole, one[1] + off * (n / whole), one[2] + apart + off * off * (one[0] * n / whole)


def payload_centroids(rows: DataFrame, payload: str = "payload", by: list[str] = KEY) -> DataFrame:
    """centroids() of the byte shares of payloads. Tasks sum up what they read by key; of these sums a task holds one key at a time, in their order."""
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.select(*by).dtypes)
    width = len(by)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        keys: list[pa.DataType] = []
        task, made = TaskContext.get().partitionId(), 0

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*held), keys)]
            numbers = [pa.array([task] * len(held), pa.int64()), pa.array([made] * len(held), pa.int64()), pa.array([v[0] for v in held.values()], pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, *numbers, *(_arrays(np.stack([v[k] for v in held.values()]), pa.float64()) for k in (1, 2))], [*by, "task", "made", "n", "mean", "apart"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [c.type for c in batch.columns[:width]]
            codes = _groups(batch.columns[:width])
            for a, b, counts, size in _slices(batch.column(width)):
                order = np.argsort(codes[a:b], kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(codes[a:b][order]) > 0])
                n = np.diff(np.r_[starts, b - a])
                x = _shares(counts, size)[order]
                mean = np.add.reduceat(x, starts) / n[:, None]
                x -= np.repeat(mean, n, axis=0)
                apart = np.add.reduceat(x * x, starts)
                heads = pa.array(a + order[starts])
                for k, key in enumerate(zip(*(c.take(heads).to_pylist() for c in batch.columns[:width]))):
                    held[key] = _merged(held[key], int(n[k]), mean[k], apart[k]) if key in held else (int(n[k]), mean[k].copy(), apart[k].copy())
                if len(held) > HELD_KEYS:
                    yield out()
                    held.clear()
                    made += 1
        if held:
            yield out()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, own, types = None, None, []

        def out() -> pa.RecordBatch:
            n, mean = np.array([v[0] for _, v in done]), np.stack([v[1] for _, v in done])
            spread = np.stack([v[2] for _, v in done]) / n[:, None]
            lists = [_arrays(x, pa.float64()) for x in (mean, spread + mean**2, np.sqrt(spread))]
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*(k for k, _ in done)), types)), *lists, pa.array(n, pa.int64())], [*by, "mean", "squares", "std", "n"])

        for batch in batches:
            types = [c.type for c in batch.columns[:width]]
            n = batch.column(width + 2).to_pylist()
            mean, apart = (batch.column(k).flatten().to_numpy().reshape(-1, 256) for k in (width + 3, width + 4))
            for k, here in enumerate(zip(*(c.to_pylist() for c in batch.columns[:width]))):
                if own is not None and here == key:
                    own = _merged(own, n[k], mean[k], apart[k])
                    continue
                if own is not None:
                    done.append((key, own))
                if len(done) >= SLICE_ROWS:
                    yield out()
                    done.clear()
                key, own = here, (n[k], mean[k].copy(), apart[k].copy())
        if own is not None:
            done.append((key, own))
            yield out()

    parts = rows.select(*by, F.col(payload).cast("binary")).mapInArrow(summed, f"{kinds}, task long, made long, n long, mean array<double>, apart array<double>")
    return parts.repartition(*by).sortWithinPartitions(*by, "task", "made").mapInArrow(joined, f"{kinds}, mean array<double>, squares array<double>, std array<double>, n long")


def centroids(rows: DataFrame, by: list[str] = KEY, freq: str = "freq") -> DataFrame:
    """mean, squares, std (arrays of 256) and n of each key, from freq."""
    long = rows.select(*by, F.posexplode(freq).alias("byte", "x")).groupBy(*by, "byte").agg(F.avg("x").alias("m"), F.avg(F.col("x") * F.col("x")).alias("q"), F.stddev_pop("x").alias("s"), F.count("*").alias("n"))
    line = F.array_sort(F.collect_list(F.struct("byte", "m", "q", "s")))
    return long.groupBy(*by).agg(line.alias("v"), F.max("n").alias("n")).select(*by, F.col("v.m").alias("mean"), F.col("v.q").alias("squares"), F.col("v.s").alias("std"), "n")


def nearest_lengths(rows: DataFrame, table: DataFrame) -> DataFrame:
    """protocol, port, length of rows, and near_length, that of the table's centroids which is nearest; ties to the shorter, null without one.

    Each (protocol, port, length) is looked up once, against the sorted lengths of its protocol and port.
    """
    lengths = table.groupBy(F.col("protocol").alias("p"), F.col("port").alias("q")).agg(F.collect_set("length").alias("lengths"))
    wanted = rows.select(*KEY).distinct()
    near = F.array_min(F.transform("lengths", lambda x: F.struct(F.abs(x - F.col("length")).alias("far"), x.alias("near"))))["near"]
    found = wanted.join(lengths, wanted["protocol"].eqNullSafe(F.col("p")) & wanted["port"].eqNullSafe(F.col("q")), "left")
    return found.select(*KEY, near.alias("near_length"))


def nearest_centroid(rows: DataFrame, table: DataFrame, ident: list[str], values: list[str]) -> DataFrame:
    """ident, near_length and the values of the centroid of its protocol and port whose length is nearest; null without one."""
    right = nearest_lengths(rows, table).select(*[F.col(c).alias(f"__{c}") for c in KEY], "near_length")
    if values:
        right = right.join(table.select(*[F.col(c).alias(f"__t_{c}") for c in KEY], *values), F.col("__protocol").eqNullSafe(F.col("__t_protocol")) & F.col("__port").eqNullSafe(F.col("__t_port")) & (F.col("near_length") == F.col("__t_length")), "left")
    same = [rows[c].eqNullSafe(F.col(f"__{c}")) for c in KEY]
    return rows.join(right, same, "left").select(*ident, "near_length", *values)


def distances(rows: DataFrame, table: DataFrame, ident: list[str], smoothing: float = 1e-4, paper: bool = True) -> DataFrame:
    """ident and distance of each row (protocol, port, length, freq) from its nearest centroid."""
    near = nearest_centroid(rows, table, [*ident, "freq"], ["mean", "std"])
    return near.select(*ident, distance(F.col("mean"), F.col("std"), F.col("freq"), smoothing, paper).alias("distance"))


def payload_distances(rows: DataFrame, table: DataFrame, ident: list[str], payload: str = "payload", smoothing: float = 1e-4, paper: bool = True) -> DataFrame:
    """distances() of rows (protocol, port, length and a payload), whose byte shares exist in tasks alone.

    Rows meet their centroid in the order of its key; keys of many rows are dealt to several parts, which get the centroid each.
    """
    near = nearest_lengths(rows, table)
    sizes = rows.groupBy(*KEY).agg(F.count("*").alias("rows")).select(*[F.col(c).alias(f"__{c}") for c in KEY], "rows")
    near = near.join(sizes, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in KEY]).select(*KEY, "near_length", "rows")
    whole = near.groupBy("protocol", "port", "near_length").agg(F.ceil(F.sum("rows") / PART_ROWS).alias("parts"))
    place = [F.col(c).alias(f"__{c}") for c in ("protocol", "port", "near_length")]
    right = near.select(*KEY, "near_length").join(whole.select(*place, "parts"), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("protocol", "port", "near_length")])
    right = right.select(*[F.col(c).alias(f"__k_{c}") for c in KEY], "near_length", "parts")
    left = rows.join(right, [rows[c].eqNullSafe(F.col(f"__k_{c}")) for c in KEY], "left")
    head = [F.col("protocol").alias("__protocol"), F.col("port").alias("__port")]
    lists = [F.lit(None).cast("array<double>").alias(n) for n in ("mean", "std")]
    queries = left.select(*head, F.col("near_length").cast("double").alias("__near"), F.pmod(F.xxhash64(*ident, payload), F.coalesce("parts", F.lit(1))).alias("__part"), F.lit(1).alias("__row"), *lists, F.col(payload).cast("binary").alias("__payload"), *ident)
    kinds = dict(rows.dtypes)
    points = table.join(whole.select(*place, "parts"), F.col("protocol").eqNullSafe(F.col("__protocol")) & F.col("port").eqNullSafe(F.col("__port")) & (F.col("length") == F.col("__near_length")))
    points = points.select(F.col("protocol").alias("__protocol"), F.col("port").alias("__port"), F.col("length").cast("double").alias("__near"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("__part"), F.lit(0).alias("__row"), "mean", "std", F.lit(None).cast("binary").alias("__payload"), *[F.lit(None).cast(kinds[i]).alias(i) for i in ident])
    key = ["__protocol", "__port", "__near", "__part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mean, std = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = _groups(batch.columns[:4])
            starts = np.flatnonzero(np.r_[True, np.diff(codes) != 0])
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                own = tuple(c[start].as_py() for c in batch.columns[:4])
                if own != held:
                    held, mean = own, None
                if batch.column(4)[start].as_py() == 0:
                    mean, std = (np.array(batch.column(k)[start].as_py()) for k in (5, 6))
                    start += 1
                mine = batch.slice(start, end - start)
                for a, b, counts, size in _slices(mine.column(7)):
                    far = np.full(b - a, -1.0)
                    if mean is not None:
                        far = ((np.abs(mean - _shares(counts, size)) if paper else np.broadcast_to(mean, counts.shape)) / (std + smoothing)).sum(1)
                    yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in mine.columns[8:]), pa.array(far)], [*ident, "distance"])

    met = queries.unionAll(points).repartition(*key).sortWithinPartitions(*key, "__row")
    return met.mapInArrow(run, ", ".join(f"`{i}` {kinds[i]}" for i in ident) + ", distance double")


def distance(mean: Column, std: Column, freq: Column, smoothing: float = 1e-4, paper: bool = True) -> Column:
    """Sum of |mean - freq| / (std + smoothing); paper=False leaves the payload out. -1 without a centroid."""
    over = F.zip_with(mean, freq, lambda m, f: F.abs(m - f)) if paper else mean
    total = F.aggregate(F.zip_with(over, std, lambda a, s: a / (s + F.lit(smoothing))), F.lit(0.0), lambda s, x: s + x)
    return F.when(mean.isNull(), F.lit(-1.0)).otherwise(total)


def merge_neighbours(length: list[float], n: list[int], mean: np.ndarray, squares: np.ndarray, threshold: float):
    """Passes over one protocol and port until nothing merges: neighbours by length nearer than threshold become one."""
    merged = threshold > 0
    while merged:
        merged, at, out = False, 0, []
        while at < len(n):
            if at + 1 < len(n) and np.abs(mean[at] - mean[at + 1]).sum() < threshold:
                w = n[at] / (n[at] + n[at + 1])
                out.append(((length[at] + length[at + 1]) / 2, n[at] + n[at + 1], w * mean[at] + (1 - w) * mean[at + 1], w * squares[at] + (1 - w) * squares[at + 1]))
                merged, at = True, at + 2
            else:
                out.append((length[at], n[at], mean[at], squares[at]))
                at += 1
        out.sort(key=lambda r: r[0])
        length, n = [r[0] for r in out], [r[1] for r in out]
        mean, squares = np.array([r[2] for r in out]), np.array([r[3] for r in out])
    return length, n, mean, squares


def cluster(table: DataFrame, threshold: float) -> DataFrame:
    """Centroids after merging neighbours; a group is one protocol and port, bounded by its lengths."""

    def run(pdf):
        pdf = pdf.sort_values("length")
        length, n, mean, squares = merge_neighbours(pdf["length"].tolist(), pdf["n"].tolist(), np.stack(pdf["mean"]), np.stack(pdf["squares"]), threshold)
        std = np.sqrt(np.maximum(squares - mean**2, 0))
        return pd.DataFrame({"protocol": pdf["protocol"].iloc[0], "port": pdf["port"].iloc[0], "length": length, "mean": list(mean), "squares": list(squares), "std": list(std), "n": n})

    kinds = dict(table.dtypes)
    schema = f"protocol {kinds['protocol']}, port {kinds['port']}, length double, mean array<double>, squares array<double>, std array<double>, n long"
    return table.withColumn("length", F.col("length").cast("double")).groupBy("protocol", "port").applyInPandas(run, schema)


def flow_distances(rows: DataFrame, by: list[str], value: str = "distance") -> DataFrame:
    named = {"mean": F.avg(value), "min": F.min(value), "max": F.max(value), "std": F.stddev_pop(value)}
    return rows.groupBy(*by).agg(*[c.alias(f"{n}_payl_dist") for n, c in named.items()])


def neighbour_distances(table: DataFrame) -> DataFrame:
    """Each centroid with the next longer one of its protocol and port and their Manhattan distance: what clustering compares."""
    order = Window.partitionBy("protocol", "port").orderBy("length")
    both = table.select(*KEY, "mean", F.lead("length").over(order).alias("next_length"), F.lead("mean").over(order).alias("__next")).where("next_length is not null")
    return both.select(*KEY, "next_length", l1_distance(F.col("mean"), F.col("__next")).alias("distance"))


def by_length(table: DataFrame) -> DataFrame:
    return table.orderBy(*KEY)
