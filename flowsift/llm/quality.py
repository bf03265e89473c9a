"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

score = sigmoid(bias + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]); the identity makes all pairwise interactions
linear in the non-zero inputs. Words are hashed to WORDS places with log counts; each statistic is one-hot in
quantile bins, so that its interactions with words and with other statistics are learned.

At most SAMPLE labelled documents outside the held-out fold, those with the smallest hash of doc_id, are used to fit, and of these as many, in that
order, as have PLACES non-zero inputs together; so at most 12 bytes for each of PLACES go to the driver.

Defined cases: null text counts as empty; empty texts get a score like any other; without labels the score is 0.5; conflicting
repeated labels count as the larger; null labels and ids are ignored in learning; of rows that repeat a labelled id, the text of the smallest hash
is learned from; extra columns are ignored, and labels, lang,
source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.common import fold, stored

SAMPLE, PLACES = 12_000, 5_000_000
WORDS = 1 << 14
FACTORS, BINS, EPOCHS, BATCH, RATE, RIDGE = 6, 12, 12, 256, 0.08, 2e-5
THRESHOLD = 0.3
CACHED_WORDS = 400_000
STATISTICS = ("chars", "words", "word_length", "upper", "digit", "space", "stop", "comma", "mark", "symbol", "pipe", "high", "distinct", "top_word", "lines", "line_repeats", "tails", "long_words", "capital_words")


class _Hashed(dict):
    """Raw word to (place, has three or more trailing symbols, starts with a capital)."""

    def __missing__(self, raw: str) -> tuple[int, bool, bool]:
        core = raw.rstrip(".,;:!?#&%$*|")
        found = self[raw] = zlib.crc32(core.lower().encode("utf-8", "surrogatepass")) % WORDS, len(raw) - len(core) > 2, raw[:1].isupper()
        return found


def inputs(text: str | None, hashed: _Hashed) -> tuple[list[float], np.ndarray, np.ndarray]:
    """Statistics, word places and their values."""
    text = text or ""
    if len(hashed) > CACHED_WORDS:
        hashed.clear()
    seen = Counter(text.split())
    n = sum(seen.values())
    places: dict[int, int] = {}
    tails = capitals = long_ = 0
    for raw, k in seen.items():
        place, tail, capital = hashed[raw]
        places[place] = places.get(place, 0) + k
        tails += k * tail
        capitals += k * capital
        long_ += k * (len(raw) > 18)
    data = text.encode("utf-8", "surrogatepass")
    byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(1, len(data))
    lines = text.split("\n")
    share = lambda chars: byte[list(chars)].sum() / size
    stats = [
        np.log1p(len(data)), np.log1p(n), len(data) / max(1, n), byte[65:91].sum() / size, byte[48:58].sum() / size, share(b" \n\t"), share(b"."), share(b","), share(b"!?"), share(b"#&%$*@^~"), share(b"|"),
        byte[128:].sum() / size, len(seen) / max(1, n), max(seen.values(), default=0) / max(1, n), np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), tails / max(1, n), long_ / max(1, n), capitals / max(1, n),
    ]
    at = np.fromiter(places.keys(), np.int64, len(places))
    value = np.log1p(np.fromiter(places.values(), np.float64, len(places)))
    return stats, at, value / max(1e-9, np.sqrt((value**2).sum()))


@dataclass
class Machine:
    edges: np.ndarray  # statistics x inner edges of the bins
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    @staticmethod
    def size() -> int:
        return WORDS + len(STATISTICS) * BINS

    def places(self, stats: np.ndarray) -> np.ndarray:
        """The place of each statistic's bin."""
        bins = np.stack([np.searchsorted(e, s, "right") for e, s in zip(self.edges, stats.T)], axis=1)
        return WORDS + np.arange(len(STATISTICS)) * BINS + bins

    def raw(self, at: np.ndarray, value: np.ndarray, start: np.ndarray):
        """Score before the sigmoid for rows beginning at start, and the sums of the factors."""
        v = self.factors[at] * value[:, None]
        sums = np.add.reduceat(v, start, axis=0)
        return self.bias + np.add.reduceat(self.linear[at] * value, start) + 0.5 * (sums**2 - np.add.reduceat(v**2, start, axis=0)).sum(axis=1), sums


def _rows(machine: Machine, stats: np.ndarray, ats: list[np.ndarray], values: list[np.ndarray]):
    """Words and statistic bins as one ragged row each."""
    bins = machine.places(stats)
    weight = np.full(len(STATISTICS), 1 / np.sqrt(len(STATISTICS)))
    at = np.concatenate([x for pair in zip(bins, ats) for x in pair])
    value = np.concatenate([x for v in values for x in (weight, v)])
    size = np.array([len(a) + len(STATISTICS) for a in ats])
    return at, value, np.cumsum(size) - size, size


def _train(machine: Machine, stats, ats, values, y: np.ndarray) -> None:
    """AdaGrad on log loss, batches in a seeded order."""
    order, total = np.random.default_rng(11), machine.size()
    squares = [1e-8, np.full(total, 1e-8), np.full((total, FACTORS), 1e-8)]
    for _ in range(EPOCHS):
        mixed = order.permutation(len(y))
        for b in range(0, len(y), BATCH):
            pick = mixed[b : b + BATCH]
            at, value, start, size = _rows(machine, stats[pick], [ats[i] for i in pick], [values[i] for i in pick])
            raw, sums = machine.raw(at, value, start)
            error = (1 / (1 + np.exp(-np.clip(raw, -35, 35))) - y[pick]) / len(pick)
            e = np.repeat(error, size) * value
            row = np.repeat(np.arange(len(pick)), size)
            linear = np.bincount(at, e, total) + RIDGE * machine.linear
            own = machine.factors[at]
            grad = e[:, None] * (sums[row] - own * value[:, None])
            factors = np.stack([np.bincount(at, grad[:, f], total) for f in range(FACTORS)], axis=1) + RIDGE * machine.factors
            squares[0] += error.sum() ** 2
            squares[1] += linear**2
            squares[2] += factors**2
            machine.bias -= RATE * error.sum() / np.sqrt(squares[0])
            machine.linear -= RATE * linear / np.sqrt(squares[1])
            machine.factors -= RATE * factors / np.sqrt(squares[2])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, places: int = PLACES) -> Machine | None:
    """The machine, from at most sample labelled rows; None without labels of both classes."""
    known = labels.select(F.col(id_col).cast("long").alias("l"), F.col(label_col).cast("int").alias("y")).where((fold(id_col) != 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    drawn = stored(known.groupBy("l").agg(F.max("y").alias("y")).orderBy(F.xxhash64("l", F.lit(5)), "l").limit(sample), "labels")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("l"))
    texts = texts.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "y", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _Hashed()
        for b in batches:
            rows = [inputs(t.as_py(), hashed) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), pa.array([np.array(r[0], float).tobytes() for r in rows], pa.binary()), pa.array([r[1].astype(np.int32).tobytes() for r in rows], pa.binary()), pa.array([r[2].astype(np.float32).tobytes() for r in rows], pa.binary())], ["doc_id", "y", "stats", "at", "value"])

    rows = stored(texts.mapInArrow(run, "doc_id long, y int, stats binary, at binary, value binary"), "inputs")
    sizes = rows.select("doc_id", (F.octet_length("at") / 4).cast("long").alias("n")).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").toPandas()
    used = sizes["doc_id"][sizes["n"].cumsum() <= places]
    if len(used) < len(sizes):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(int(i),) for i in used], "doc_id long")), "doc_id", "left_semi")
    got = rows.toArrow().sort_by("doc_id")
    y = got.column("y").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return None
    stats = np.stack([np.frombuffer(x) for x in got.column("stats").to_pylist()])
    ats = [np.frombuffer(x, np.int32).astype(np.int64) for x in got.column("at").to_pylist()]
    values = [np.frombuffer(x, np.float32).astype(float) for x in got.column("value").to_pylist()]
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    share = y.mean()
    machine = Machine(edges, float(np.log(share / (1 - share))), np.zeros(Machine.size()), np.random.default_rng(3).normal(0, 0.05, (Machine.size(), FACTORS)))
    _train(machine, stats, ats, values, y)
    return machine


def score(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hashed = sent.value, _Hashed()
        for b in batches:
            p = np.full(b.num_rows, 0.5)
            for lo in range(0, b.num_rows if m else 0, 512):
                rows = [inputs(t.as_py(), hashed) for t in b.column(1)[lo : lo + 512]]
                at, value, start, _ = _rows(m, np.array([r[0] for r in rows]), [r[1] for r in rows], [r[2] for r in rows])
                p[lo : lo + 512] = 1 / (1 + np.exp(-np.clip(m.raw(at, value, start)[0], -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
