"""One-class engines: local outlier factor, isolation forest, one-class SVM, autoencoder.

These are the models and the fits that one task does on rows that it can hold. Fits over all rows of a table are in neighbours (the outlier factor), in
isolation_forest() (each tree grows in a task from its own seeded draw of all rows) and in fitting (the SVM and the autoencoder). Rows are scored by tasks that hold
the model. A model's state is a dictionary of parameters and one of arrays.
"""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sampled(rows: DataFrame, features: str, ident: str, sample: int) -> DataFrame:
    """draw, id (text) and x of the rows with the smallest hash of ident, at most sample: a share of hashes that holds somewhat more is cut to size."""
    n = rows.count()
    share = min(1.0, (1.2 * sample + 100) / max(1, n))
    draw = F.xxhash64(ident)
    return rows.where(draw <= F.lit(int(-(2**63) + share * (2**64 - 2049)))).orderBy(draw, ident).limit(sample).select(draw.alias("draw"), F.col(ident).cast("string").alias("id"), F.col(features).cast("array<double>").alias("x"))


def sample_matrix(rows: DataFrame, features: str, ident: str, sample: int) -> np.ndarray:
    """At most sample rows, those with the smallest hash of ident (for what needs no more than a sample, as the choice of pivots)."""
    return np.array([r["x"] for r in sampled(rows, features, ident, sample).collect()], float)


#: Kernel values or distances that are held at a time.
CELLS = 1 << 20
_STATE = "params string, name string, shape array<int>, data binary"


def state_rows(model) -> list[tuple]:
    """A model's class and parameters, and its arrays as rows of _STATE."""
    params, arrays = model.state()
    kinds = [("", [], b"", "")] + [(n, list(v.shape), np.ascontiguousarray(v).tobytes(), v.dtype.str) for n, v in arrays.items()]
    return [(json.dumps({"class": type(model).__name__, "dtype": kind, "params": params if not name else {}}), name, shape, data) for name, shape, data, kind in kinds]


def model_of(rows: list) -> object:
    """The model of state_rows()."""
    arrays, head = {}, {}
    for r in rows:
        meta = json.loads(r["params"])
        if r["name"]:
            arrays[r["name"]] = np.frombuffer(bytes(r["data"]), meta["dtype"]).reshape(r["shape"]).copy()
        else:
            head = meta
    return MODELS[head["class"]].restored(head["params"], arrays)


def state_table(model) -> pa.Table:
    """state_rows() for a task to return, as _STATE."""
    return pa.table([pa.array(c, t) for c, t in zip(zip(*state_rows(model)), (pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()))], ["params", "name", "shape", "data"])


def score_rows(rows: DataFrame, ident: str, features: str, fn: Callable[[np.ndarray], np.ndarray], name: str = "score") -> DataFrame:
    kind = dict(rows.dtypes)[ident]
    sent = rows.sparkSession.sparkContext.broadcast(fn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value(np.array(b.column(1).to_pylist(), float)), pa.float64())], [ident, name])

    return rows.select(ident, features).mapInArrow(run, f"`{ident}` {kind}, {name} double")


def _counts(x, y):
    """Of rows taken as sets of their non-zero places: in both, in one or the other alone, in neither."""
    a, b = x != 0, y != 0
    return [np.sum(v, axis=2).astype(float) for v in (a & b, a & ~b, ~a & b, ~a & ~b)]


def _over(num, den):
    return np.divide(num, den, out=np.zeros(np.broadcast_shapes(num.shape, den.shape)), where=den != 0)


#: Distances of every row of x from every row of y (both as rows x 1 x columns and 1 x rows x columns), by name.
_DISTANCES: dict[str, Callable] = {
    "manhattan": lambda x, y: np.abs(x - y).sum(2),
    "chebyshev": lambda x, y: np.abs(x - y).max(2),
    "sqeuclidean": lambda x, y: ((x - y) ** 2).sum(2),
    "canberra": lambda x, y: _over(np.abs(x - y), np.abs(x) + np.abs(y)).sum(2),
    "braycurtis": lambda x, y: _over(np.abs(x - y).sum(2), np.abs(x + y).sum(2)),
    "cosine": lambda x, y: 1 - _over((x * y).sum(2), np.sqrt((x**2).sum(2) * (y**2).sum(2))),
    "hamming": lambda x, y: (x != y).mean(2),
    "jaccard": lambda x, y: _over((c := _counts(x, y))[1] + c[2], c[0] + c[1] + c[2]),
    "dice": lambda x, y: _over((c := _counts(x, y))[1] + c[2], 2 * c[0] + c[1] + c[2]),
    "kulsinski": lambda x, y: ((c := _counts(x, y))[1] + c[2] - c[0] + x.shape[2]) / (c[1] + c[2] + x.shape[2]),
    "rogerstanimoto": lambda x, y: 2 * ((c := _counts(x, y))[1] + c[2]) / (x.shape[2] + c[1] + c[2]),
    "sokalmichener": lambda x, y: 2 * ((c := _counts(x, y))[1] + c[2]) / (x.shape[2] + c[1] + c[2]),
    "russellrao": lambda x, y: (x.shape[2] - _counts(x, y)[0]) / x.shape[2],
    "sokalsneath": lambda x, y: _over(2 * ((c := _counts(x, y))[1] + c[2]), c[0] + 2 * (c[1] + c[2])),
    "yule": lambda x, y: _over(2 * (c := _counts(x, y))[1] * c[2], c[0] * c[3] + c[1] * c[2]),
}
_DISTANCES |= {"cityblock": _DISTANCES["manhattan"], "l1": _DISTANCES["manhattan"]}
#: Those that are Euclidean distances once the columns are prepared, and those that need the training rows for it.
_EUCLIDEAN, _FITTED = ("minkowski", "euclidean", "l2", "correlation"), ("mahalanobis", "seuclidean")
METRICS = (*_EUCLIDEAN, *_FITTED, *_DISTANCES)


def space_matrix(covariance: np.ndarray, metric: str) -> np.ndarray:
    """The matrix that makes a fitted metric Euclidean: for mahalanobis from the covariance, for seuclidean from the variances."""
    if metric == "mahalanobis":
        values, vectors = np.linalg.eigh(covariance)
        return vectors * np.sqrt(_over(np.ones_like(values), np.where(values > 1e-12, values, 0)))
    return np.diag(_over(np.ones(len(covariance)), np.sqrt(np.diag(covariance))))


def metric_space(train: np.ndarray, metric: str) -> np.ndarray | None:
    return space_matrix(np.atleast_2d(np.cov(train.T)), metric) if metric in _FITTED else None


def distance_block(x: np.ndarray, y: np.ndarray, metric: str = "minkowski", p: float = 2, space: np.ndarray | None = None) -> np.ndarray:
    """Distances of all rows of x and y."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if metric == "correlation":
        return _DISTANCES["cosine"]((x - x.mean(1, keepdims=True))[:, None], (y - y.mean(1, keepdims=True))[None])
    if space is not None:
        x, y = x @ space, y @ space
    if metric in _FITTED or metric in _EUCLIDEAN and (metric != "minkowski" or p == 2):
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0))
    if metric == "minkowski":
        return (np.abs(x[:, None] - y[None]) ** p).sum(2) ** (1 / p)
    return _DISTANCES[metric](x[:, None], y[None])


def _smallest(d: np.ndarray, k: int) -> np.ndarray:
    """The places of the k smallest of each row in their order, ties to the smaller place, as a stable sort gives them."""
    if d.shape[1] < 4 * k + 64:
        return np.argsort(d, axis=1, kind="stable")[:, :k]
    at = np.sort(np.argpartition(d, k - 1, axis=1)[:, :k], axis=1)
    near = np.take_along_axis(d, at, 1)
    last = near.max(axis=1, keepdims=True)
    at = np.take_along_axis(at, np.argsort(near, axis=1, kind="stable"), 1)
    # of more equal ones than have a place, those that come first do
    for i in np.flatnonzero(~((d <= last).sum(axis=1) == k)):
        at[i] = np.argsort(d[i], kind="stable")[:k]
    return at


def _near(x: np.ndarray, train: np.ndarray, k: int, p: float, skip_self: bool, metric: str = "minkowski", space: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distances and places of the k nearest training rows, in blocks."""
    out_d, out_i = [], []
    rows = 256 if metric in _EUCLIDEAN[:3] and p == 2 else max(1, 8_000_000 // max(1, train.size))
    for a in range(0, len(x), rows):
        part = x[a : a + rows]
        d = distance_block(part, train, metric, p, space)
        if skip_self:
            d[np.arange(len(part)), a + np.arange(len(part))] = np.inf
        at = _smallest(d, k)
        near = np.take_along_axis(d, at, 1)
        if metric in _EUCLIDEAN[:3] and (metric != "minkowski" or p == 2):  # once more without the loss of digits of the product form
            exact = np.sqrt(((part[:, None] - train[at]) ** 2).sum(2))
            near = np.where(np.isinf(near), near, exact)
            order = np.lexsort((at, near), axis=1)
            at, near = np.take_along_axis(at, order, 1), np.take_along_axis(near, order, 1)
        out_i.append(at)
        out_d.append(near)
    return np.concatenate(out_d), np.concatenate(out_i)


@dataclass
class LocalOutlierFactor:
    """Novelty form: factor over 1.5 is an attack."""

    train: np.ndarray
    reach: np.ndarray
    density: np.ndarray
    k: int
    p: float
    metric: str = "minkowski"
    space: np.ndarray | None = None

    @classmethod
    def fit(cls, train: np.ndarray, k: int = 20, p: float = 2, metric: str = "minkowski") -> LocalOutlierFactor:
        k, space = min(k, len(train) - 1), metric_space(train, metric)
        d, i = _near(train, train, k, p, True, metric, space)
        reach = d[:, -1]
        density = 1 / (np.maximum(d, reach[i]).mean(1) + 1e-10)
        return cls(train, reach, density, k, p, metric, space)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        d, i = _near(x, self.train, self.k, self.p, False, self.metric, self.space)
        own = 1 / (np.maximum(d, self.reach[i]).mean(1) + 1e-10)
        return self.density[i].mean(1) / own

    def state(self) -> tuple[dict, dict]:
        space = {} if self.space is None else {"space": self.space}
        return {"k": self.k, "p": self.p, "metric": self.metric}, {"train": self.train, "reach": self.reach, "density": self.density} | space

    @classmethod
    def restored(cls, params: dict, arrays: dict) -> LocalOutlierFactor:
        return cls(**arrays, **params)


def isolation_forest(rows: DataFrame, ident: str, features: str, trees: int = 100, max_samples: float | int = 256, max_features: float = 0.5, seed: int = 0, bootstrap: bool = False) -> IsolationForest | None:
    """The forest whose trees each grow from max_samples rows (up to 1: that share of them) drawn of all rows: those of the smallest seeded hash, with bootstrap as many draws of these. None without rows."""
    n = rows.count()
    if not n:
        return None
    size = min(int(max_samples if max_samples > 1 else max(2, max_samples * n)), n)
    # a row is sent to a tree if its hash is in a share that holds twice the sample; all rows are if that is most of them
    share = 1.0 if n <= 4 * size else (2 * size + 200) / n
    draws = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(seed), t, F.col(ident)).alias("draw")))
    drawn = rows.select(features, ident, F.explode(F.filter(draws, lambda x: x["draw"] <= F.lit(int(-(2**63) + min(share, 1.0) * (2**64 - 2049))))).alias("t"))
    drawn = drawn.select("t.tree", "t.draw", F.col(ident).cast("string").alias("ident"), F.col(features).alias("v"))

    def grow(key, table):
        x = table.sort_by([("draw", "ascending"), ("ident", "ascending")]).slice(0, size).column("v").to_pylist()
        forest = IsolationForest(np.array(x, float), 1, max(2, size), max_features, seed * 1_000_003 + key[0].as_py(), bootstrap)
        return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "nodes": pa.array([forest.trees[0].tobytes()], pa.binary())})

    grown = drawn.groupBy("tree").applyInArrow(grow, "tree int, nodes binary").orderBy("tree").collect()
    return IsolationForest.restored({"size": size}, {str(r["tree"]): np.frombuffer(r["nodes"]).reshape(-1, 5) for r in grown})


class IsolationForest:
    """Seeded isolation trees; a score over 0.5 is an attack. A tree is a table of nodes: column (-1 in a leaf), cut, left, right, value."""

    def __init__(self, train: np.ndarray, trees: int = 100, max_samples: float | int = 256, max_features: float = 0.5, seed: int = 0, bootstrap: bool = False) -> None:
        rng = np.random.default_rng(seed)
        size = int(max_samples if max_samples > 1 else max(2, max_samples * len(train)))
        self.size = min(size, len(train))
        columns = max(1, int(max_features * train.shape[1]))
        self.trees: list[np.ndarray] = []
        for _ in range(trees):
            rows = rng.choice(len(train), self.size, replace=bootstrap)
            nodes: list[list[float]] = []
            self._grow(train[rows], rng.choice(train.shape[1], columns, replace=False), rng, math.ceil(math.log2(max(2, self.size))), nodes)
            self.trees.append(np.array(nodes, float))

    def _grow(self, x, columns, rng, depth, nodes: list) -> int:
        own = len(nodes)
        wide = [c for c in columns if x[:, c].min() < x[:, c].max()] if len(x) > 1 and depth else []
        if not wide:
            nodes.append([-1, 0, 0, 0, self.average(len(x))])
            return own
        c = int(rng.choice(wide))
        cut = float(rng.uniform(x[:, c].min(), x[:, c].max()))
        nodes.append([c, cut, 0, 0, 0])
        left = x[:, c] <= cut
        nodes[own][2] = self._grow(x[left], columns, rng, depth - 1, nodes)
        nodes[own][3] = self._grow(x[~left], columns, rng, depth - 1, nodes)
        return own

    @staticmethod
    def average(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            at, depth, row = np.zeros(len(x), np.int64), 0, np.arange(len(x))
            while len(row):
                node = tree[at[row]]
                leaf = node[:, 0] < 0
                total[row[leaf]] += depth + node[leaf, 4]
                row, node, depth = row[~leaf], node[~leaf], depth + 1
                at[row] = np.where(x[row, node[:, 0].astype(np.int64)] <= node[:, 1], node[:, 2], node[:, 3]).astype(np.int64)
        return 2 ** (-total / max(1, len(self.trees)) / max(self.average(self.size), 1e-9))

    def state(self) -> tuple[dict, dict]:
        return {"size": self.size}, {str(i): t for i, t in enumerate(self.trees)}

    @classmethod
    def restored(cls, params: dict, arrays: dict) -> IsolationForest:
        out = cls.__new__(cls)
        out.size, out.trees = params["size"], [arrays[k] for k in sorted(arrays, key=int)]
        return out


class OneClassSvm:
    """The nu formulation by pairwise coordinate steps; a negative value is an attack.

    Kernel columns are computed when they are needed, and the last ones kept, up to cache_mb. Steps go on until the gap is below tol; if max_iter (-1: none) ends
    them before, a warning is given and converged is false. total: rows that the training rows stand for (the others have no weight); start: weights to begin with, which
    sum to 1. top is the largest kernel sum of a row with weight: a row outside whose sum is below top - tol would get weight.
    """

    def __init__(self, train: np.ndarray, nu: float = 0.001, gamma: float = 0.005, kernel: str = "rbf", tol: float = 1e-3, coef0: float = 0.0, degree: int = 3, max_iter: int = -1, cache_mb: float = 500, total: int | None = None, start: np.ndarray | None = None) -> None:
        self.kernel, self.gamma, self.coef0, self.degree = kernel, gamma, coef0, degree
        n, stood_for = len(train), total or len(train)
        bound = 1 / (nu * stood_for)
        alpha = np.zeros(n)
        full = min(n, int(nu * stood_for))
        alpha[:full] = bound
        if full < n:
            alpha[full] = 1 - full * bound
        if start is not None:
            alpha = np.minimum(start / max(1.0, start.sum()), bound)
            spare = 1 - alpha.sum()
            for i in np.flatnonzero(alpha < bound) if spare > 1e-12 else ():
                more = min(spare, bound - alpha[i])
                alpha[i] += more
                spare -= more
        held, most = {}, max(2, int(cache_mb * 1e6 / (8 * n)))

        def column(i: int) -> np.ndarray:
            if i not in held:
                if len(held) >= most:
                    del held[next(iter(held))]
                held[i] = self._k(train, train[i : i + 1])[:, 0]
            return held[i]

        g, weighted = np.zeros(n), np.flatnonzero(alpha)
        for a in range(0, len(weighted), 256):
            some = weighted[a : a + 256]
            for b in range(0, n, CELLS // 256):
                g[b : b + CELLS // 256] += self._k(train[b : b + CELLS // 256], train[some]) @ alpha[some]
        self.converged, steps = False, 0
        while max_iter < 0 or steps < max_iter:
            up, down = np.where(alpha < bound * (1 - 1e-9), g, np.inf), np.where(alpha > bound * 1e-9, g, -np.inf)
            i, j = int(up.argmin()), int(down.argmax())
            if down[j] - up[i] < tol:
                self.converged = True
                break
            x, y = column(i), column(j)
            step = min((g[j] - g[i]) / max(x[i] + y[j] - 2 * x[j], 1e-12), bound - alpha[i], alpha[j])
            alpha[i] += step
            alpha[j] -= step
            g += step * (x - y)
            steps += 1
        if not self.converged:
            warnings.warn(f"stopped after {steps} steps above the tolerance of {tol}", stacklevel=2)
        least = 1e-6 * bound
        free = (alpha > least) & (alpha < bound - least)
        self.rho = float(g[free].mean() if free.any() else (g[alpha > least].max() + g[alpha <= least].min()) / 2 if (alpha <= least).any() else g.max())
        self.support, self.alpha, self.top, self.kept = train[alpha > least], alpha[alpha > least], float(g[alpha > least].max()), np.flatnonzero(alpha > least)

    def _k(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dot = a @ b.T
        if self.kernel == "rbf":
            return np.exp(-self.gamma * np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * dot, 0))
        return {"linear": lambda: dot, "poly": lambda: (self.gamma * dot + self.coef0) ** self.degree, "sigmoid": lambda: np.tanh(self.gamma * dot + self.coef0)}[self.kernel]()

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for a in range(0, len(x), 256):  # few kernel values at a time, however many rows and support vectors there are
            for b in range(0, len(self.support), CELLS // 256):
                out[a : a + 256] += self._k(x[a : a + 256], self.support[b : b + CELLS // 256]) @ self.alpha[b : b + CELLS // 256]
        return out - self.rho

    def state(self) -> tuple[dict, dict]:
        return {k: getattr(self, k) for k in ("kernel", "gamma", "coef0", "degree", "rho", "converged", "top")}, {"support": self.support, "alpha": self.alpha}

    @classmethod
    def restored(cls, params: dict, arrays: dict) -> OneClassSvm:
        out = cls.__new__(cls)
        out.__dict__.update(params | arrays)
        return out


def _by_slope(slope: Callable) -> Callable:
    return lambda grad, z, a: grad * slope(z, a)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


#: Of each activation its value at z, and the gradient at z (value a) of one behind it.
_ACTIVATIONS: dict[str, tuple[Callable, Callable]] = {
    "relu": (lambda z: np.maximum(z, 0), _by_slope(lambda z, a: (z > 0) * 1.0)),
    "tanh": (np.tanh, _by_slope(lambda z, a: 1 - a**2)),
    "sigmoid": (lambda z: 1 / (1 + np.exp(-z)), _by_slope(lambda z, a: a * (1 - a))),
    "hard_sigmoid": (lambda z: np.clip(0.2 * z + 0.5, 0, 1), _by_slope(lambda z, a: 0.2 * (np.abs(z) < 2.5))),
    "linear": (lambda z: z, _by_slope(lambda z, a: 1.0)),
    "exponential": (lambda z: np.exp(np.minimum(z, 50)), _by_slope(lambda z, a: a)),
    "elu": (lambda z: np.where(z > 0, z, np.exp(np.minimum(z, 0)) - 1), _by_slope(lambda z, a: np.where(z > 0, 1.0, a + 1))),
    "selu": (lambda z: 1.05070098 * np.where(z > 0, z, 1.67326324 * (np.exp(np.minimum(z, 0)) - 1)), _by_slope(lambda z, a: np.where(z > 0, 1.05070098, a + 1.05070098 * 1.67326324))),
    "softplus": (lambda z: np.logaddexp(0, z), _by_slope(lambda z, a: 1 / (1 + np.exp(-z)))),
    "softsign": (lambda z: z / (1 + np.abs(z)), _by_slope(lambda z, a: 1 / (1 + np.abs(z)) ** 2)),
    "softmax": (_softmax, lambda grad, z, a: a * (grad - (grad * a).sum(axis=1, keepdims=True))),
}


def layer_sizes(pattern: str, width: int) -> list[int]:
    """"*r": a share of the size before, "#k": the size at place k, n: as given; places count the input as 0."""
    sizes = [width]
    for part in (p.strip() for p in pattern.split(",")):
        sizes.append(max(1, round(sizes[-1] * float(part[1:]))) if part[0] == "*" else sizes[int(part[1:])] if part[0] == "#" else int(part))
    return sizes[1:]


class _Dense:
    def __init__(self, rng, a: int, b: int, activation: str) -> None:
        self.params = {"w": rng.normal(0, math.sqrt(2 / (a + b)), (a, b)), "b": np.zeros(b)}
        self.act, self.back = _ACTIVATIONS[activation]

    def forward(self, x, rng=None):
        self.x, self.z = x, x @ self.params["w"] + self.params["b"]
        self.a = self.act(self.z)
        return self.a

    def backward(self, grad):
        grad = self.back(grad, self.z, self.a)
        self.grads = {"w": self.x.T @ grad, "b": grad.sum(0)}
        return grad @ self.params["w"].T


class _BatchNorm:
    """Batch statistics while training (a generator is given), their moving averages else."""

    def __init__(self, width: int) -> None:
        self.params = {"gamma": np.ones(width), "beta": np.zeros(width)}
        self.moving = {"mean": np.zeros(width), "var": np.ones(width)}

    def forward(self, x, rng=None):
        if rng is None:
            return (x - self.moving["mean"]) / np.sqrt(self.moving["var"] + 1e-3) * self.params["gamma"] + self.params["beta"]
        mean, var = x.mean(0), x.var(0)
        for k, v in (("mean", mean), ("var", var)):
            self.moving[k] = 0.99 * self.moving[k] + 0.01 * v
        self.scale = 1 / np.sqrt(var + 1e-3)
        self.hat = (x - mean) * self.scale
        return self.hat * self.params["gamma"] + self.params["beta"]

    def backward(self, grad):
        self.grads = {"gamma": (grad * self.hat).sum(0), "beta": grad.sum(0)}
        grad = grad * self.params["gamma"]
        return self.scale * (grad - grad.mean(0) - self.hat * (grad * self.hat).mean(0))


class _Dropout:
    params: dict = {}
    grads: dict = {}

    def __init__(self, ratio: float) -> None:
        self.ratio = ratio

    def forward(self, x, rng=None):
        self.kept = 1.0 if rng is None else (rng.random(x.shape) >= self.ratio) / (1 - self.ratio)
        return x * self.kept

    def backward(self, grad):
        return grad * self.kept


class Autoencoder:
    """Dense layers trained by Adam; the value is a row's reconstruction error.

    dropout: the share dropped behind the first layer and each hidden one, none if negative. batch_norm: after the activation of each hidden
    layer. patience: epochs without a smaller training loss after which training ends with the best weights; none if negative.
    """

    def __init__(self, train: np.ndarray, layers: str = "*0.7,*0.8,#1", activation: str = "relu", epochs: int = 50, batch: int = 256, loss: str = "mse", rate: float = 1e-3, seed: int = 0, dropout: float = -1, batch_norm: bool = False, patience: int = -1) -> None:
        d = train.shape[1]
        self._build(d, [d, *layer_sizes(layers, d)], activation, loss, dropout, batch_norm, seed)
        rng = np.random.default_rng(seed + 1)
        self._begin(rate, patience)
        for _ in range(epochs):
            order, total = rng.permutation(len(train)), 0.0
            for a in range(0, len(train), batch):
                error, grads = self.gradients(train[order[a : a + batch]], rng)
                total += error
                self.step([g / len(order[a : a + batch]) for g in grads])
            if self.finished(total / len(train)):
                break
        self.end()

    @classmethod
    def untrained(cls, d: int, layers: str = "*0.7,*0.8,#1", activation: str = "relu", loss: str = "mse", rate: float = 1e-3, seed: int = 0, dropout: float = -1, batch_norm: bool = False, patience: int = -1) -> Autoencoder:
        out = cls.__new__(cls)
        out._build(d, [d, *layer_sizes(layers, d)], activation, loss, dropout, batch_norm, seed)
        out._begin(rate, patience)
        return out

    def _begin(self, rate: float, patience: int) -> None:
        self.rate, self.patience, self.history, self.steps = rate, patience, [], 0
        self.moments: list | None = None
        self.best, self.waited = (math.inf, None), 0

    def gradients(self, x: np.ndarray, rng) -> tuple[float, list[np.ndarray]]:
        """The summed loss of some rows, and the gradients of that sum by the weights in their order."""
        diff = self._run(x, rng) - x
        error = float((diff**2 if self.params["loss"] == "mse" else np.abs(diff)).mean(1).sum())
        grad = (2 * diff if self.params["loss"] == "mse" else np.sign(diff)) / diff.shape[1]
        for layer in reversed(self.net):
            grad = layer.backward(grad)
        return error, [layer.grads[k] for layer in self.net for k in layer.params]

    def step(self, grads: list[np.ndarray]) -> None:
        """One step of Adam along the gradients of the mean loss."""
        self.steps += 1
        self.moments = self.moments or [(np.zeros_like(g), np.zeros_like(g)) for g in grads]
        places = [(layer, k) for layer in self.net for k in layer.params]
        for i, ((layer, k), g) in enumerate(zip(places, grads)):
            m, v = self.moments[i]
            m, v = self.moments[i] = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            layer.params[k] -= self.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-7)

    def finished(self, loss: float) -> bool:
        """Notes an epoch's mean loss; whether the patience is over."""
        self.history.append(loss)
        if self.patience >= 0:
            if loss < self.best[0]:
                self.best, self.waited = (loss, self.state()[1]), 0
            else:
                self.waited += 1
        return self.patience >= 0 and self.waited > self.patience

    def end(self) -> None:
        """Goes back to the best weights, if there is a patience."""
        if self.best[1]:
            self._load(self.best[1])

    def _build(self, d: int, sizes: list[int], activation: str, loss: str, dropout: float, batch_norm: bool, seed: int = 0) -> None:
        self.params = {"d": d, "sizes": sizes, "activation": activation, "loss": loss, "dropout": dropout, "batch_norm": batch_norm}
        rng = np.random.default_rng(seed)
        self.net: list = []
        for i, (a, b) in enumerate(zip([d, *sizes], sizes)):
            self.net.append(_Dense(rng, a, b, activation))
            if i and batch_norm:
                self.net.append(_BatchNorm(b))
            if dropout >= 0:
                self.net.append(_Dropout(dropout))
        self.net.append(_Dense(rng, sizes[-1], d, "linear"))

    def _run(self, x: np.ndarray, rng=None) -> np.ndarray:
        for layer in self.net:
            x = layer.forward(x, rng)
        return x

    def __call__(self, x: np.ndarray) -> np.ndarray:
        diff = self._run(x) - x
        return (diff**2).mean(1) if self.params["loss"] == "mse" else np.abs(diff).mean(1)

    def state(self) -> tuple[dict, dict]:
        return self.params, {f"{i}.{k}": v.copy() for i, layer in enumerate(self.net) for k, v in (layer.params | getattr(layer, "moving", {})).items()}

    def _load(self, arrays: dict) -> None:
        for name, v in arrays.items():
            i, k = name.split(".")
            layer = self.net[int(i)]
            (layer.params if k in layer.params else layer.moving)[k] = v.copy()

    @classmethod
    def restored(cls, params: dict, arrays: dict) -> Autoencoder:
        out = cls.__new__(cls)
        out._build(**{k: v for k, v in params.items() if k != "history"})
        out._load(arrays)
        out.history = params.get("history", [])
        return out

    def __getstate__(self):
        return self.state()

    def __setstate__(self, state):
        self.__dict__.update(Autoencoder.restored(*state).__dict__)


MODELS = {c.__name__: c for c in (LocalOutlierFactor, IsolationForest, OneClassSvm, Autoencoder)}


def exact_percentile(rows: DataFrame, value: str, share: float, most: int = 20_000) -> float | None:
    """The percentile of the values that are not null, linear between neighbours; None without any.

    Sketches narrow an interval around its ranks until at most `most` values, or equal ones, are left in it; so no task or driver holds more than that.
    """
    values = rows.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    n = values.count()
    if not n:
        return None
    place = share * (n - 1)
    ranks = [math.floor(place), math.ceil(place)]
    low, high = values.agg(F.min("v"), F.max("v")).first()
    before, inside = 0, n  # values below low, values from low to high
    while inside > most and low < high:
        near = values.where(F.col("v").between(low, high))
        shares = [min(1.0, max(0.0, (r - before) / inside + move)) for r, move in zip(ranks, (-2e-4, 2e-4))]
        a, b = near.agg(F.percentile_approx("v", shares, 10_000)).first()[0]
        less, upto = near.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v") <= b)).first()
        new_low, new_high = a if before + less <= ranks[0] else low, b if before + upto > ranks[1] else high
        if (new_low, new_high) == (low, high):
            # both ends hold many equal values: go on between them, unless a rank is theirs
            low_n, high_n = near.agg(F.count_if(F.col("v") == low), F.count_if(F.col("v") == high)).first()
            if before + low_n > ranks[1]:
                return low
            if before + inside - high_n <= ranks[0]:
                return high
            between = near.where((F.col("v") > low) & (F.col("v") < high)).agg(F.min("v"), F.max("v")).first()
            if between[0] is None or before + low_n > ranks[0] or before + inside - high_n <= ranks[1]:
                pair = [low if r < before + low_n else high if r >= before + inside - high_n else (between[0] if r == before + low_n else between[1]) for r in ranks]
                return pair[0] + (place - ranks[0]) * (pair[1] - pair[0])
            before, inside, (low, high) = before + low_n, inside - low_n - high_n, between
            continue
        before += less if new_low == a else 0
        low, high = new_low, new_high
        inside = values.where(F.col("v").between(low, high)).count()
    if low == high:
        return low
    held = sorted(r[0] for r in values.where(F.col("v").between(low, high)).collect())  # at most `most`
    pair = [held[r - before] for r in ranks]
    return pair[0] + (place - ranks[0]) * (pair[1] - pair[0])


def over_percentile(rows: DataFrame, value: str, share: float, name: str = "label") -> DataFrame:
    """Adds name: whether value is over its exact percentile (linear between neighbours); 0 for null."""
    limit = exact_percentile(rows, value, share)
    return rows.withColumn(name, F.coalesce((F.col(value) > F.lit(limit)).cast("int"), F.lit(0)))
