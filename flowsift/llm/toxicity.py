"""Toxicity by Levenshtein automata over a lexicon trie.

The lexicon is learned from labelled documents: words, and stems (word beginnings), that occur far more
often in toxic documents than chance allows. Words are held in a trie, and a lazily determinised Levenshtein automaton
is intersected with it, so that one walk over a word tells which terms lie within the edits that their length allows; a
stem must match exactly. Every hit is scored in its window of words: inside quotation marks, or after a reporting
verb, it counts as quotation. A logistic regression over the sums of exact, misspelled, stem and quoted hits gives a calibrated score.

Labels come from rows outside the held-out fold alone, at most SAMPLE of each class, those with the smallest hash of
doc_id. The regression is fitted on one half of them with the lexicon of the other, so that terms which only fit
their own half weigh little; the final lexicon comes from both.

Defined cases: null text counts as empty; empty texts score as texts without hits; without any usable labels the
score is 0; conflicting repeated labels count as toxic; null labels and null ids are ignored in learning; of rows that repeat a labelled id, the
text of the smallest hash is learned from; extra columns are kept, but for those with the names that score() gives its own.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.common import fold, free_names, quoted, stored

SAMPLE = 8192
LEAST_EVIDENCE = 13.0
PURITY = 8.0
#: Log lift from which a term is also sought misspelled.
FUZZY_LIFT = 5.0
STEMS = range(3, 8)
WINDOW = 8
THRESHOLD = 0.5
CACHED_WORDS, STATES = 200_000, 50_000
#: Verbs and nouns that announce a quotation, in four languages.
REPORTING = frozenset("said says say saying called calls wrote writes quoted quote quotes quoting reported reports word words term slur insult dit disait écrit cité citation mot sagte sagt schrieb zitat zitiert wort dijo dice escribió cita palabra".split())
OPENERS, MARKS = frozenset("\"“„«‚‘"), frozenset("\"“”„«»‚‘’")
EDGE = " \t\r\n.,;:!?()[]{}<>|/\\*#&%$_~^+=-–—\"“”„«»‚‘’'`…"


def allowed_edits(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton:
    """The lexicon trie times the Levenshtein automaton, made deterministic as words walk it."""

    def __init__(self, terms: list[tuple[str, bool, float]]) -> None:
        """terms: (text, is a stem, weight)."""
        self.child: list[dict[str, int]] = [{}]
        self.word: list[tuple[int, float] | None] = [None]
        self.stem: list[float] = [0.0]
        for text, stem, weight in terms:
            node = 0
            for c in text:
                node = self.child[node].setdefault(c, len(self.child))
                if node == len(self.child):
                    self.child.append({})
                    self.word.append(None)
                    self.stem.append(0.0)
            if stem:
                self.stem[node] = max(self.stem[node], weight)
            else:
                self.word[node] = (allowed_edits(len(text)) if weight >= FUZZY_LIFT else 0, weight)
        self.most = [0] * len(self.child)
        for node in range(len(self.child) - 1, -1, -1):
            own = self.word[node]
            self.most[node] = max([own[0] if own else 0, *(self.most[x] for x in self.child[node].values())])
        self._restart()

    def _restart(self) -> None:
        """Forgets all states that words have walked to."""
        self.states: list[dict[int, int]] = []
        self.number: dict[frozenset, int] = {}
        self.next: list[dict[str, int]] = []
        self.begin = self._state({0: 0})

    def _state(self, edits: dict[int, int]) -> int:
        todo = list(edits.items())
        while todo:  # letters of the term that the text leaves out
            node, e = todo.pop()
            for x in self.child[node].values():
                if e < self.most[x] and edits.get(x, 99) > e + 1:
                    edits[x] = e + 1
                    todo.append((x, e + 1))
        key = frozenset(edits.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(edits)
            self.next.append({})
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        to: dict[int, int] = {}
        for node, e in self.states[state].items():
            if e < self.most[node] and e + 1 < to.get(node, 99):
                to[node] = e + 1  # a letter that the term lacks
            for letter, x in self.child[node].items():
                cost = e + (letter != c)
                if cost <= self.most[x] and cost < to.get(x, 99) or letter == c and e == 0:
                    to[x] = min(cost, to.get(x, 99))
        found = self.next[state][c] = self._state(to) if to else -1
        return found

    def match(self, word: str) -> tuple[int, float] | None:
        """(0 exact, 1 misspelled, 2 stem; weight) of the best term, or None."""
        if len(self.states) > STATES:
            self._restart()
        state, best = self.begin, 0.0
        for at, c in enumerate(word):
            to = self.next[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return (2, best) if best else None
            for node, e in self.states[state].items():
                if not e and self.stem[node] > best and at + 1 < len(word):
                    best = self.stem[node]
        ends = [(e > 0, -self.word[n][1]) for n, e in self.states[state].items() if self.word[n] and e <= self.word[n][0]]
        if ends and (not min(ends)[0] or not best):
            far, weight = min(ends)
            return int(far), -weight
        return (2, best) if best else None


def clean_word(raw: str) -> str:
    return raw.strip(EDGE).lower()


class Scanner:
    """The feature vector of a text."""

    NAMES = ("exact", "misspelled", "stem", "quoted", "density", "length")

    def __init__(self, terms: list[tuple[str, bool, float]]) -> None:
        self.automaton, self.known = Automaton(terms), {}

    def hit(self, raw: str):
        found = self.known[raw] = self.automaton.match(clean_word(raw))
        return found

    def features(self, text: str | None) -> list[float]:
        words = (text or "").split()
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for raw in set(words):
            if raw not in known:
                self.hit(raw)
        hits = [(i, h) for i, h in enumerate(map(known.__getitem__, words)) if h]
        sums = [0.0, 0.0, 0.0, 0.0]
        for i, (kind, weight) in hits:
            sums[3 if self.is_quoted(words, i) else kind] += weight
        return [*(math.log1p(x) for x in sums), sum(sums[:3]) / (len(words) + 20.0), math.log1p(len(words))]

    @staticmethod
    def is_quoted(words: list[str], at: int) -> bool:
        """Whether the word stands between quotation marks, or shortly after a reporting verb, in its window."""
        left, right = words[max(0, at - WINDOW) : at], words[at + 1 : at + 1 + WINDOW]
        opened = words[at][:1] in OPENERS or any(w[:1] in OPENERS and not any(x[-1:] in MARKS or x[-2:-1] in MARKS for x in left[k:]) for k, w in enumerate(left))
        closed = any(x[-1:] in MARKS or x[-2:-1] in MARKS for x in (words[at], *right))
        return opened and closed or any(clean_word(w) in REPORTING for w in left[-3:])


@dataclass
class ToxicityModel:
    terms: list[tuple[str, bool, float]] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [0.0] * len(Scanner.NAMES))
    bias: float = -40.0
    centre: list[float] = field(default_factory=lambda: [0.0] * len(Scanner.NAMES))
    scale: list[float] = field(default_factory=lambda: [1.0] * len(Scanner.NAMES))


def _evidence(a: float, n: float, b: float, m: float) -> float:
    """Log-likelihood ratio that a of n and b of m have different rates."""

    def part(k, size, rate):
        return (k * math.log(rate) if k else 0) + ((size - k) * math.log(1 - rate) if size > k else 0)

    both = (a + b) / (n + m)
    return 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, both) - part(b, m, both)) if 0 < both < 1 else 0.0


def _lexicon(counts: list[tuple], halves: tuple[int, ...], sizes: dict[tuple[int, int], int]) -> list[tuple[str, bool, float]]:
    """counts: (term, is a stem, toxic in half 0, clean in 0, toxic in 1, clean in 1)."""
    toxic, clean = (sum(sizes.get((h, t), 0) for h in halves) for t in (1, 0))
    if not toxic or not clean:
        return []
    out = []
    for term, stem, *n in counts:
        a, b = sum(n[2 * h] for h in halves), sum(n[2 * h + 1] for h in halves)
        lift = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        if lift > math.log(PURITY) and _evidence(a, toxic, b, clean) >= LEAST_EVIDENCE:
            out.append((term, stem, lift))
    return sorted(out)


def _regression(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method for weighted logistic regression; the last coefficient is the bias."""
    x = np.c_[x, np.ones(len(x))]
    beta, keep = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (w * (y - p)) - keep * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Learns from labels outside the held-out fold; sample bounds the documents of each class."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where((fold(id_col) != 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    known = stored(known.withColumn("r", F.xxhash64("doc_id", F.lit(7))), "labels")
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    drawn = [known.where(F.col("y") == y).orderBy("r", "doc_id").limit(sample) for y in (0, 1)]
    drawn = drawn[0].unionAll(drawn[1]).select(F.col("doc_id").alias("l"), "y", F.pmod("r", F.lit(2)).cast("int").alias("half"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(drawn), F.col("doc_id") == F.col("l"))
    texts = stored(texts.groupBy("doc_id", "y", "half").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")), "labelled")
    sizes = {(r["half"], r["y"]): r["n"] for r in texts.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, bool], list[int]] = {}
        for b in batches:
            for text, y, half in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = {w for w in map(clean_word, set(text.split())) if len(w) > 2}
                terms = Counter((w, False) for w in words)
                terms.update((s, True) for s in {w[:k] for w in words for k in STEMS if len(w) > k})
                for t in terms:
                    seen.setdefault(t, [0, 0, 0, 0])[2 * half + (1 - y)] += 1
        columns = [[t[0] for t in seen], [t[1] for t in seen], *(list(c) for c in zip(*seen.values()))] if seen else [[]] * 6
        kinds = [pa.string(), pa.bool_(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["term", "stem", "a0", "b0", "a1", "b1"])

    counts = texts.select("text", "y", "half").mapInArrow(count, "term string, stem boolean, a0 long, b0 long, a1 long, b1 long")
    counts = counts.groupBy("term", "stem").agg(*[F.sum(c).alias(c) for c in ("a0", "b0", "a1", "b1")])
    toxic, clean = (sum(v for (_, y), v in sizes.items() if y == t) for t in (1, 0))
    if not toxic or not clean:
        return ToxicityModel()
    rate = (F.col("a0") + F.col("a1")) / toxic > PURITY / 2 * (F.col("b0") + F.col("b1")) / clean
    rows = [tuple(r) for r in counts.where(rate & (F.col("a0") + F.col("a1") >= 3)).collect()]
    first, both = _lexicon(rows, (0,), sizes), _lexicon(rows, (0, 1), sizes)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(first)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([scan.features(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1)], ["x", "y"])

    seen = texts.where("half = 1").select("text", "y").mapInArrow(measure, "x array<double>, y int").collect()
    if len({r["y"] for r in seen}) < 2:
        return ToxicityModel(both)
    x, y = np.array([r["x"] for r in seen]), np.array([r["y"] for r in seen], float)
    centre, scale = x.mean(0), x.std(0) + 1e-9
    share = [totals.get(t, 0) / max(1, (y == t).sum()) for t in (0, 1)]
    weight = np.where(y == 1, share[1], share[0]) * len(y) / sum(totals.values())
    used = np.ones(x.shape[1], bool)
    while True:  # a hit of any kind never speaks for a text
        beta = np.zeros(x.shape[1] + 1)
        beta[np.r_[used, True]] = _regression(((x - centre) / scale)[:, used], y, weight)
        against = np.flatnonzero(beta[:-2] < 0)
        if not len(against):
            break
        used[against] = False
    return ToxicityModel(both, beta[:-1].tolist(), float(beta[-1]), centre.tolist(), scale.tolist())


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """docs with score_col and predicted_col added; columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c.lower() not in (score_col.lower(), predicted_col.lower())]
    own = free_names([*names, score_col, predicted_col], "own_text")[0]
    lower = [c.lower() for c in names]
    at = lower.index(text_col.lower()) if text_col.lower() in lower else len(names)
    rows = docs.select(*quoted(names), *[F.col(text_col).alias(own)] * (at == len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scan, w = Scanner(m.terms), np.array(m.weights)
        for b in batches:
            x = (np.array([scan.features(t.as_py()) for t in b.column(at)]).reshape(-1, len(w)) - m.centre) / m.scale
            p = 1 / (1 + np.exp(-np.clip(x @ w + m.bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, score_col, predicted_col])

    kept = docs.select(*quoted(names)).schema
    return rows.mapInArrow(run, kept.add(score_col, "double").add(predicted_col, "integer"))


def keep_clean(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the toxic ones, all columns as they were."""
    verdict = free_names(docs.columns, "toxicity_score", "toxicity_verdict")
    return score(docs, model, id_col, text_col, threshold, *verdict).where(F.col(verdict[1]) == 0).select(*quoted(docs.columns))
