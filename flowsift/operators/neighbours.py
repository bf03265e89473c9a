"""k nearest rows and the local outlier factor over all rows, exact for every metric.

Rows of a metric space are indexed by pivots, rows of a bounded sample that lie far from each other. A row belongs to the cell of its nearest pivot and
there to a ring of distances from it; a ring of a cell, dealt by a hash if it holds too many rows, is a block. Of each block, the smallest and largest distance to every pivot
are known, and by the triangle inequality these bound the distance of two blocks, or of a row and a block, from below. A block of queries first meets
the blocks closest to it, which gives each query a bound on the distance of its k-th neighbour; then it meets only the blocks within the largest of
its bounds, and there a query is compared only if the block lies within its own. Names of METRICS that are no metrics (the triangle inequality does not hold) are
computed over all pairs of blocks.

Defined cases: ids are unique; null vectors must be left out before. Rows of equal distance rank by id. Fewer rows than k give as many neighbours as there are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.functions.scratch import discard, written
from flowsift.operators import engines

#: Rows of a block, at least; rows of the sample that pivots are chosen from, pivots, and blocks, at most.
BLOCK, PIVOT_SAMPLE, MOST_PIVOTS, MOST_BLOCKS, RINGS = 8192, 2048, 64, 20_000, 64
_EUCLIDEAN = ("euclidean", "l2")
TRUE_METRICS = frozenset((*_EUCLIDEAN, "manhattan", "cityblock", "l1", "chebyshev", "canberra", "hamming", "jaccard", "rogerstanimoto", "sokalmichener", "sokalsneath"))


@dataclass(frozen=True)
class Space:
    """A metric by name; matrix makes rows of a fitted metric Euclidean."""

    metric: str = "minkowski"
    p: float = 2
    matrix: np.ndarray | None = None

    def prepared(self, x: np.ndarray) -> np.ndarray:
        return x if self.matrix is None else x @ self.matrix

    @property
    def name(self) -> str:
        """The metric of prepared rows."""
        return "euclidean" if self.matrix is not None or self.metric == "minkowski" and self.p == 2 else self.metric

    @property
    def prunes(self) -> bool:
        return self.name in TRUE_METRICS or self.name == "minkowski" and self.p >= 1

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of prepared rows, without the loss of digits of the product form."""
        step = max(1, 2_000_000 // max(1, y.size))
        one = (lambda a: np.sqrt(((a[:, None] - y[None]) ** 2).sum(2))) if self.name in _EUCLIDEAN else (lambda a: engines.distance_block(a, y, self.name, self.p))
        return np.concatenate([one(x[at : at + step]) for at in range(0, len(x), step)]) if len(x) else np.zeros((0, len(y)))

    def nearest(self, x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return engines._near(x, y, min(k, len(y)), 2 if self.name in _EUCLIDEAN else self.p, False, self.name)


def space_of(rows: DataFrame, features: str, metric: str = "minkowski", p: float = 2) -> Space:
    """The space of a metric; mahalanobis and seuclidean are fitted to all rows."""
    if metric not in engines.METRICS:
        raise ValueError(f"unknown metric {metric}")
    if metric not in ("mahalanobis", "seuclidean"):
        return Space(metric, p)

    def summed(mean: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                x = np.array(b.column(0).to_pylist(), float)
                if len(x):
                    part = np.r_[len(x), x.sum(0)] if mean is None else (x - mean).T @ (x - mean)
                    total = part if total is None else total + part
            total = np.zeros(0) if total is None else total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"])

        found = rows.select(features).mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()
        return np.array([r["value"] for r in found])

    sums = summed(None)
    if not len(sums):
        return Space(metric, p, None)
    covariance = summed(sums[1:] / sums[0]).reshape(len(sums) - 1, -1) / max(1.0, sums[0] - 1)
    return Space(metric, p, engines.space_matrix(covariance, metric))


@dataclass
class _Index:
    space: Space
    pivots: np.ndarray
    cuts: dict[int, np.ndarray]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell and the ring of each row."""
        apart = self.space.between(x, self.pivots)
        cell = apart.argmin(1)
        ring = apart[np.arange(len(x)), cell]
        return cell, np.array([np.searchsorted(self.cuts[c], r) if c in self.cuts else 0 for c, r in zip(cell.tolist(), ring)], np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def _index(points: DataFrame, space: Space, n: int, block: int) -> _Index:
    """points: id, v, as all rows of this module."""
    sample = space.prepared(engines.sample_matrix(points, "v", "id", PIVOT_SAMPLE))
    wanted = int(min(MOST_PIVOTS, len(sample), max(8, 2 * n // block)))
    chosen = [int(np.abs(sample - sample.mean(0)).sum(1).argmin())]
    far = space.between(sample, sample[chosen])[:, 0]
    while len(chosen) < wanted and far.max() > 0:  # each as far as can be from those before
        chosen.append(int(far.argmax()))
        far = np.minimum(far, space.between(sample, sample[chosen[-1:]])[:, 0])
    index = _Index(space, sample[chosen], {})

    def rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apart = index.space.between(index.space.prepared(_matrix(b.column(0))), index.pivots) if b.num_rows else np.zeros((0, 1))
            cell = apart.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(apart[np.arange(len(cell)), cell])], ["cell", "ring"])

    shares = [i / RINGS for i in range(1, RINGS)]
    cells = points.select("v").mapInArrow(rings, "cell int, ring double").groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("ring", shares, 1000).alias("cuts")).collect()
    for r in cells:
        parts = min(RINGS, -(-r["n"] // block))
        index.cuts[r["cell"]] = np.unique([r["cuts"][round(RINGS * i / parts) - 1] for i in range(1, parts)])
    return index


def _dealt(rows: DataFrame, index: _Index, block: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """Rows (block, id, v, prepared) and, for each block, its number of rows and the least and largest distances to the pivots."""
    rows = rows.withColumn("draw", F.xxhash64("id"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            if b.num_rows:
                seen.update(zip(*(a.tolist() for a in index.place(index.space.prepared(_matrix(b.column(0)))))))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())], ["cell", "ring", "n"])

    # at most as many rows as there are rings of pivots
    sizes = rows.select("v").mapInArrow(counted, "cell long, ring long, n long").groupBy("cell", "ring").agg(F.sum("n").alias("n")).orderBy("cell", "ring").collect()
    numbers, made = {}, 0
    for r in sizes:
        numbers[r["cell"], r["ring"]] = (made, max(1, -(-r["n"] // block)))
        made += numbers[r["cell"], r["ring"]][1]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = index.space.prepared(_matrix(b.column(1)))
                first, parts = np.array([numbers[k] for k in zip(*(a.tolist() for a in index.place(x)))], np.int64).T
                own = first + b.column(2).to_numpy() % parts
                yield pa.RecordBatch.from_arrays([pa.array(own), b.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["block", "id", "v"])

    out = written(rows.select("id", "v", "draw").mapInArrow(dealt, f"block long, id {kind}, v array<double>"), "neighbour_blocks")

    def boxed(key, table):
        apart = index.space.between(_matrix(table.column("v").combine_chunks()), index.pivots)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([len(apart)], pa.int64()), "low": pa.array([apart.min(0).tolist()], pa.list_(pa.float64())), "high": pa.array([apart.max(0).tolist()], pa.list_(pa.float64()))})

    return out, written(out.groupBy("block").applyInArrow(boxed, "block long, n long, low array<double>, high array<double>"), "neighbour_boxes")


def _pairs(boxes: DataFrame, against: list, choose) -> DataFrame:
    """q, p: pairs of blocks. choose: of a row of boxes and the arrays (block, n, low, high) of those of the points, the places of some."""
    block, n = (np.array([r[c] for r in against], np.int64) for c in ("block", "n"))
    low, high = (np.array([r[c] for r in against], float) for c in ("low", "high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            found = [block[choose(r, n, low, high)] for r in rows]
            mine = np.repeat([r["block"] for r in rows], [len(f) for f in found]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))], ["q", "p"])

    return boxes.mapInArrow(run, "q long, p long")


def _apart(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """At least so far are a box and others from each other."""
    return np.maximum(np.maximum(low - other_high, other_low - high), 0).max(-1)


def _met(queries: DataFrame, points: DataFrame, pairs: DataFrame, boxes: list | None, index: _Index | None, space: Space, k: int, kind: str) -> DataFrame:
    """query_id, point_id, distance, q: of each pair of blocks the k nearest points of every query; of those with a bound, the points within it."""
    own = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  columns of their own, where queries are the points
    left = queries.join(pairs.select(*own("q", "p")), F.col("block") == F.col("q")).select(*own("q", "p", "id", "v", *["bound"] * (index is not None)))
    right = points.join(pairs.select(*own("q", "p")), F.col("block") == F.col("p")).select(*own("q", "p", "id", "v"))
    box = {r["block"]: (np.array(r["low"]), np.array(r["high"])) for r in boxes or []}

    def near(key, left, right):
        right = right.sort_by("id")
        x, y = (_matrix(t.column("v").combine_chunks()) for t in (left, right))
        ids = left.column("id").combine_chunks()
        if index is not None and len(x):
            bound = left.column("bound").to_numpy()
            apart = index.space.between(x, index.pivots)
            low, high = box[key[1].as_py()]
            open_ = np.flatnonzero(_apart(apart, apart, low, high) <= _slack(bound))
            x, ids, bound = x[open_], ids.take(pa.array(open_)), bound[open_]
        if not len(x) or not len(y):
            return pa.table([ids.slice(0, 0), ids.slice(0, 0), pa.array([], pa.float64()), pa.array([], pa.int64())], ["query_id", "point_id", "distance", "q"])
        d, i = space.nearest(x, y, k)
        keep = np.flatnonzero(d.ravel() <= np.repeat(_slack(bound), d.shape[1])) if index is not None else np.arange(d.size)
        mine = np.repeat(np.arange(len(x)), d.shape[1])[keep]
        return pa.table([ids.take(pa.array(mine)), right.column("id").combine_chunks().take(pa.array(i.ravel()[keep])), pa.array(d.ravel()[keep]), pa.array(np.full(len(keep), key[0].as_py()))], ["query_id", "point_id", "distance", "q"])

    return left.groupBy("q", "p").cogroup(right.groupBy("q", "p")).applyInArrow(near, f"query_id {kind}, point_id {kind}, distance double, q long")


def _slack(bound: np.ndarray) -> np.ndarray:
    return bound * (1 + 1e-9) + 1e-9


def _best(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "point_id"))), 1, k).alias("best"))
    return best.select("query_id", "best")


def knn(queries: DataFrame, points: DataFrame, k: int, ident: str = "vec_id", features: str = "embedding", p: float = 2, block: int = BLOCK, metric: str = "minkowski", space: Space | None = None, same: bool = True, report: dict | None = None) -> DataFrame:
    """query_id, point_id, rank, distance of the k nearest points of each query, ties to the smaller id; same: a row is no neighbour of its own id.

    space: that of the points, if it is known. report: gets the number of pairs of blocks, and of those that met."""
    kind = dict(points.dtypes)[ident]
    space = space or space_of(points, features, metric, p)
    mine, theirs = (r.select(F.col(ident).alias("id"), F.col(features).cast("array<double>").alias("v")) for r in (queries, points))
    n, take = theirs.count(), k + same
    block = max(block, -(-n // MOST_BLOCKS))
    keep = "query_id != point_id" if same else "true"
    if not space.prunes or n <= block:
        parts = [max(1, -(-size // block)) for size in (mine.count(), n)]
        prepared = [_prepared(r, space, kind, size) for r, size in zip((mine, theirs), parts)]
        every = mine.sparkSession.range(parts[0] * parts[1]).select(F.floor(F.col("id") / parts[1]).alias("q"), (F.col("id") % parts[1]).alias("p"))
        found = _met(*prepared, every, None, None, space, take, kind).where(keep)
        if report is not None:
            report |= {"pairs": parts[0] * parts[1], "met": parts[0] * parts[1]}
    else:
        index = _index(theirs, space, n, block)
        points_, boxes = _dealt(theirs, index, block, kind)
        queries_, own = (points_, boxes) if queries is points else _dealt(mine, index, block, kind)
        against = boxes.collect()  # at most MOST_BLOCKS and one for each ring

        def closest(r, size, low, high):
            far = _apart(np.array(r["low"]), np.array(r["high"]), low, high) + 1e-3 * np.abs(low + high - np.array(r["low"]) - np.array(r["high"])).sum(1)
            order = np.argsort(far, kind="stable")
            return order[: int(np.searchsorted(np.cumsum(size[order]), take)) + 1]

        first_pairs = written(_pairs(own, against, closest), "neighbour_pairs")
        first = written(_met(queries_, points_, first_pairs, None, None, space, take, kind).where(keep), "neighbours")
        bounds = _best(first, k).select(F.col("query_id").alias("id"), F.when(F.size("best") == k, F.element_at("best", -1)["distance"]).alias("bound"))
        bounded = queries_.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        bounded = written(bounded.select("block", "id", "v", "bound"), "neighbour_bounds")
        limits = own.join(bounded.groupBy("block").agg(F.max("bound").alias("limit")), "block")
        reached = _pairs(limits, against, lambda r, size, low, high: np.flatnonzero(_apart(np.array(r["low"]), np.array(r["high"]), low, high) <= _slack(np.float64(r["limit"]))))
        rest = written(reached.join(first_pairs, ["q", "p"], "left_anti"), "neighbour_pairs")
        second = _met(bounded, points_, rest, against, index, space, take, kind).where(keep)
        found = first.unionByName(second)
        if report is not None:
            report |= {"pairs": own.count() * len(against), "met": first_pairs.count() + rest.count()}
    return _best(found, k).select("query_id", F.posexplode("best").alias("rank", "n")).select("query_id", "n.point_id", (F.col("rank") + 1).alias("rank"), "n.distance")


def _prepared(rows: DataFrame, space: Space, kind: str, parts: int) -> DataFrame:
    """Rows dealt to blocks by a hash."""
    rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("block"), "id", "v")
    if space.matrix is None:
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(space.prepared(_matrix(b.column(2)))), pa.list_(pa.float64()))], ["block", "id", "v"])

    return rows.mapInArrow(run, f"block long, id {kind}, v array<double>")


def neighbours(rows: DataFrame, ident: str, features: str, k: int, p: float = 2, block: int = BLOCK, metric: str = "minkowski", space: Space | None = None, report: dict | None = None) -> DataFrame:
    """query_id, point_id, rank, distance of the k nearest other rows of every row."""
    return knn(rows, rows, k, ident, features, p, block, metric, space, True, report)


def _densities(near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of each row with its neighbours the distance of the last (point_id, reach), and its density (point_id, density)."""
    reach = near.groupBy("query_id").agg(F.max("distance").alias("reach")).select(F.col("query_id").alias("point_id"), "reach")
    density = near.join(reach, "point_id").groupBy("query_id").agg((1 / (F.avg(F.greatest("distance", "reach")) + 1e-10)).alias("density"))
    return reach, density.withColumnRenamed("query_id", "point_id")


def local_outlier_factor(rows: DataFrame, ident: str, features: str, k: int = 20, p: float = 2, metric: str = "minkowski", block: int = BLOCK) -> DataFrame:
    """ident, score: the factor of every row against all rows, itself among them, as LocalOutlierFactor scores its own training rows. ident is unique."""
    n = rows.count()
    if n < 2:
        return rows.select(ident, F.lit(1.0).alias("score")).limit(n)
    k = min(k, n - 1)
    near = written(neighbours(rows, ident, features, k, p, block, metric), "near")
    reach, density = _densities(near)
    # scored as new rows, rows are their own first neighbours
    own = near.select("query_id").distinct().select("query_id", F.col("query_id").alias("point_id"), F.lit(0.0).alias("distance"))
    scored = near.where(F.col("rank") < k).select("query_id", "point_id", "distance").unionByName(own)
    scored = scored.join(reach, "point_id").join(density, "point_id")
    return scored.groupBy(F.col("query_id").alias(ident)).agg((F.avg("density") * (F.avg(F.greatest("distance", "reach")) + 1e-10)).alias("score"))


@dataclass
class StoredOutlierFactor:
    """The factor of new rows against training rows that lie in a table (id, v, reach, density) at path."""

    path: str
    k: int
    space: Space

    def score(self, rows: DataFrame, ident: str, features: str) -> DataFrame:
        """ident, score of every row."""
        train = rows.sparkSession.read.parquet(self.path)
        named = rows.select(F.monotonically_increasing_id().cast("string").alias("id"), F.col(ident), F.col(features).cast("array<double>").alias("v"))
        named = written(named, "scored_rows")
        near = knn(named.select("id", "v"), train.select(F.col("id").cast("string").alias("id"), "v"), self.k, "id", "v", space=self.space, same=False)
        near = near.join(train.select(F.col("id").cast("string").alias("point_id"), "reach", "density"), "point_id")
        scored = near.groupBy(F.col("query_id").alias("id")).agg((F.avg("density") * (F.avg(F.greatest("distance", "reach")) + 1e-10)).alias("score"))
        return named.join(scored, "id").select(ident, "score")

    def state(self) -> tuple[dict, dict]:
        return {"path": self.path, "k": self.k, "metric": self.space.metric, "p": self.space.p}, {} if self.space.matrix is None else {"matrix": self.space.matrix}

    @classmethod
    def restored(cls, params: dict, arrays: dict) -> StoredOutlierFactor:
        return cls(params["path"], params["k"], Space(params["metric"], params["p"], arrays.get("matrix")))


def fit_outlier_factor(rows: DataFrame, ident: str, features: str, path: str, k: int = 20, p: float = 2, metric: str = "minkowski") -> StoredOutlierFactor | None:
    """The model of all rows, written to path; None without rows."""
    rows = written(rows.select(F.col(ident).alias("id"), F.col(features).cast("array<double>").alias("v")), "train")
    n, space = rows.count(), space_of(rows, "v", metric, p)
    if not n:
        return None
    k = max(1, min(k, n - 1))
    near = written(neighbours(rows, "id", "v", k, space=space), "near")
    reach, density = _densities(near)
    table = rows.join(reach, F.col("id") == F.col("point_id"), "left").drop("point_id").join(density, F.col("id") == F.col("point_id"), "left").drop("point_id")
    table.na.fill({"reach": 0.0, "density": 1e10}).write.parquet(path)  # one row has no neighbours
    discard(near, rows)
    return StoredOutlierFactor(path, k, space)


engines.MODELS["StoredOutlierFactor"] = StoredOutlierFactor
