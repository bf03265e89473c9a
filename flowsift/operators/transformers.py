"""Feature transformers over an array column of features; fitted values are small and kept as plain lists."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Scaler:
    """(x - shift) / scale by place; a scale of zero is one."""

    shift: list[float]
    scale: list[float]

    def column(self, features: Column) -> Column:
        params = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b) or 1.0).alias("b")) for a, b in zip(self.shift, self.scale)])
        return F.zip_with(features, params, lambda x, p: (x - p["a"]) / p["b"])


def _stats(rows: DataFrame, features: str, *aggs) -> list:
    long = rows.select(F.posexplode(features).alias("i", "x"))
    return long.groupBy("i").agg(*[a(F.col("x").cast("double")).alias(f"v{k}") for k, a in enumerate(aggs)]).orderBy("i").collect()


def standard_scaler(rows: DataFrame, features: str = "features") -> Scaler:
    got = _stats(rows, features, F.avg, F.stddev_pop)
    return Scaler([r["v0"] for r in got], [r["v1"] for r in got])


def minmax_scaler(rows: DataFrame, features: str = "features") -> Scaler:
    """Constant columns become 0; nothing is clipped."""
    got = _stats(rows, features, F.min, F.max)
    return Scaler([r["v0"] for r in got], [r["v1"] - r["v0"] for r in got])


@dataclass
class Pca:
    mean: list[float]
    components: list[list[float]]
    variance: list[float]

    def column(self, features: Column) -> Column:
        centred = F.zip_with(features, F.array(*[F.lit(float(m)) for m in self.mean]), lambda x, m: x - m)
        dot = lambda c: F.aggregate(F.zip_with(centred, F.array(*[F.lit(float(v)) for v in c]), lambda x, v: x * v), F.lit(0.0), lambda s, x: s + x)
        return F.array(*[dot(c) for c in self.components])


def pca(rows: DataFrame, k: int, features: str = "features") -> Pca:
    """Centred principal components from one pass of moment sums; the largest weight of each is positive."""
    from collections.abc import Iterator

    import pyarrow as pa

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(0).to_pylist(), float)
                n, s, q = n + len(x), s + x.sum(axis=0), q + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tobytes()], pa.binary()), pa.array([q.tobytes()], pa.binary())], ["n", "s", "q"])

    got = rows.select(features).mapInArrow(moments, "n long, s binary, q binary").collect()
    n = sum(r["n"] for r in got)
    s = np.sum([np.frombuffer(r["s"]) for r in got], axis=0)
    q = np.sum([np.frombuffer(r["q"]) for r in got], axis=0).reshape(len(s), len(s))
    if k > min(n, len(s)):
        raise ValueError(f"{k} components need at least {k} rows and columns, not {n} and {len(s)}")
    mean = s / n
    values, vectors = np.linalg.eigh((q - n * np.outer(mean, mean)) / max(1, n - 1))
    order = np.argsort(-values)[:k]
    parts = vectors[:, order].T
    parts *= np.sign(parts[np.arange(k), np.abs(parts).argmax(axis=1)])[:, None]
    return Pca(mean.tolist(), parts.tolist(), values[order].tolist())


#: Values that a categorical column has at most: each becomes a column, and all go to the driver.
MOST_VALUES = 10_000


def vocabulary(rows: DataFrame, column: str, most: int = MOST_VALUES) -> list:
    """Sorted distinct values of a categorical column; an error if there are more than `most`, which are not fetched then."""
    found = [r[0] for r in rows.select(F.col(f"`{column}`").alias("v")).where("v IS NOT NULL").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(found)


def one_hot(rows: DataFrame, column: str, values: list) -> DataFrame:
    """An indicator per value at the end, the column dropped; other values are all 0."""
    named = [F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_ohe_{v}") for v in values]
    return rows.select("*", *named).drop(column)


#: Features kept by the fixed name filter.
FIXED_FEATURES = """
fwd_max_pkt_length
fwd_std_pkt_length
fwd_mean_pkt_length
fwd_sum_pkt_length
bwd_mean_pkt_length
bwd_sum_pkt_length
bwd_std_pkt_length
total_iat_max
total_iat_sum
total_iat_min
bwd_n_packets
total_bytes_per_s
fwd_n_packets
fwd_iat_sum
""".split()


def keep_features(rows: DataFrame, names: list[str]) -> DataFrame:
    """Columns in the list, in their own order; doubled names are refused."""
    if len(set(names)) != len(names):
        raise ValueError("feature names repeat")
    return rows.select(*[c for c in rows.columns if c in set(names)])


@dataclass
class OneHot:
    """Places of the array that hold categories give way to an indicator for each of their training values, behind the other places."""

    values: dict[int, list[float]]
    width: int

    def column(self, features: Column) -> Column:
        kept = [features[i] for i in range(self.width) if i not in self.values]
        marks = [F.coalesce((features[i] == F.lit(v)).cast("double"), F.lit(0.0)) for i, vs in self.values.items() for v in vs]
        return F.array(*kept, *marks)

    def names(self, names: list[str]) -> list[str]:
        return [n for i, n in enumerate(names) if i not in self.values] + [f"{names[i]}_ohe_{v}" for i, vs in self.values.items() for v in vs]


def one_hot_vectors(rows: DataFrame, categorical: list[int], features: str = "features") -> OneHot:
    """Fitted on the distinct values (MOST_VALUES at most) of the categorical places."""
    first = rows.select(F.size(features)).first()
    if first is None:
        raise ValueError("no rows to fit on")
    found = {i: vocabulary(rows.select(F.col(features)[i].cast("double").alias(f"feature {i}")), f"feature {i}") for i in categorical}
    return OneHot(found, first[0])


@dataclass
class Keep:
    """Some places of the array, in their own order."""

    places: list[int]

    def column(self, features: Column) -> Column:
        return F.array(*[features[i] for i in self.places])

    def names(self, names: list[str]) -> list[str]:
        return [names[i] for i in self.places]


def fixed_filter(names: list[str], allowed: list[str] | None = None) -> Keep:
    """The places of names that the fixed list, or another one, allows; doubled names are refused."""
    allowed = FIXED_FEATURES if allowed is None else allowed
    if len(set(allowed)) != len(allowed):
        raise ValueError("feature names repeat")
    return Keep([i for i, n in enumerate(names) if n in set(allowed)])


def read_names(path: str) -> list[str]:
    """Feature names of a file, one a line; a list of one's own in place of the fixed one."""
    with open(path, encoding="utf-8") as f:
        return [line.strip() for line in f if line.strip()]


STEPS = {c.__name__: c for c in (Scaler, Pca, OneHot, Keep)}


def step_state(step) -> dict:
    return {"class": type(step).__name__} | asdict(step)


def step_of(state: dict):
    state = dict(state)
    kind = STEPS[state.pop("class")]
    if kind is OneHot:
        state["values"] = {int(k): v for k, v in state["values"].items()}
    return kind(**state)


def renamed(step, names: list[str]) -> list[str]:
    """Feature names behind a step."""
    if isinstance(step, Pca):
        return [f"pca_{i}" for i in range(len(step.components))]
    return step.names(names) if hasattr(step, "names") else names
