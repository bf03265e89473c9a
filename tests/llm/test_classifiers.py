"""Quality and toxicity queries against plain scoring, and their defined cases of labels."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift.llm import quality, toxicity
from flowsift.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache(), spark.read.parquet(f"{SMALL}/labels.parquet")


def _plain_inputs(text: str) -> dict[str, float]:
    """Statistics by name and words by place, counted one by one."""
    words, data, lines = text.split(), text.encode(), text.split("\n")
    n, size = len(words), max(1, len(data))
    share = lambda keep: sum(1 for b in data if keep(b)) / size
    core = [w.rstrip(".,;:!?#&%$*|") for w in words]
    seen = Counter(words)
    stats = {
        "chars": math.log(1 + len(data)), "words": math.log(1 + n), "word_length": len(data) / max(1, n), "upper": share(lambda b: 65 <= b <= 90), "digit": share(lambda b: 48 <= b <= 57), "space": share(lambda b: b in b" \n\t"),
        "stop": share(lambda b: b == 46), "comma": share(lambda b: b == 44), "mark": share(lambda b: b in b"!?"), "symbol": share(lambda b: b in b"#&%$*@^~"), "pipe": share(lambda b: b == 124), "high": share(lambda b: b >= 128),
        "distinct": len(seen) / max(1, n), "top_word": max(seen.values(), default=0) / max(1, n), "lines": math.log(1 + len(lines)), "line_repeats": 1 - len(set(lines)) / len(lines),
        "tails": sum(len(w) - len(c) > 2 for w, c in zip(words, core)) / max(1, n), "long_words": sum(len(w) > 18 for w in words) / max(1, n), "capital_words": sum(w[0].isupper() for w in words) / max(1, n),
    }
    places = Counter(zlib.crc32(c.lower().encode()) % quality.WORDS for c in core)
    logs = {k: math.log(1 + v) for k, v in places.items()}
    length = max(1e-9, math.sqrt(sum(v * v for v in logs.values())))
    return stats, {k: v / length for k, v in logs.items()}


def test_quality_against_all_pairs_of_inputs(spark, tables):
    docs, labels = tables
    machine = quality.fit(docs, labels)
    got = {r["doc_id"]: r for r in QUERIES["op6_quality_classifier"](spark, SMALL).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        stats, x = _plain_inputs(r["text"] or "")
        for k, name in enumerate(quality.STATISTICS):
            x[quality.WORDS + k * quality.BINS + sum(stats[name] >= e for e in machine.edges[k])] = 1 / math.sqrt(len(quality.STATISTICS))
        at, value = np.array(list(x)), np.array(list(x.values()))
        pairs = np.triu((machine.factors[at] @ machine.factors[at].T) * np.outer(value, value), 1).sum()  # each pair once
        raw = machine.bias + (machine.linear[at] * value).sum() + pairs
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-6), r["doc_id"]
        assert got[r["doc_id"]]["predicted"] == (got[r["doc_id"]]["score"] >= 0.3)
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def _plain_hit(word: str, terms: list) -> tuple[int, float] | None:
    if any(not stem and t == word for t, stem, _ in terms):
        return 0, max(w for t, stem, w in terms if not stem and t == word)
    stems = [w for t, stem, w in terms if stem and word.startswith(t) and len(word) > len(t)]
    if stems:
        return 2, max(stems)
    near = []
    for t, stem, w in terms:
        edits = 0 if stem or w < toxicity.FUZZY_LIFT else 0 if len(t) < 5 else 1 if len(t) < 9 else 2
        if edits and abs(len(t) - len(word)) <= edits and _distance(t, word) <= edits:
            near.append(w)
    return (1, max(near)) if near else None


def _plain_quoted(words: list[str], at: int) -> bool:
    first = max(0, at - 8)
    ends = lambda w: w[-1:] in toxicity.MARKS or w[-2:-1] in toxicity.MARKS
    opened = words[at][0] in toxicity.OPENERS
    for k in range(first, at):
        if words[k][0] in toxicity.OPENERS and not any(ends(w) for w in words[k:at]):
            opened = True
    closed = any(ends(w) for w in words[at : at + 9])
    return opened and closed or any(toxicity.clean_word(w) in toxicity.REPORTING for w in words[max(first, at - 3) : at])


def test_toxicity_against_every_term(spark, tables):
    docs, labels = tables
    model = toxicity.fit(docs, labels)
    assert model.terms and any(model.weights)
    got = {r["doc_id"]: r for r in QUERIES["op7_toxicity"](spark, SMALL).collect()}
    known: dict = {}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        words, sums = (r["text"] or "").split(), [0.0] * 4
        for at, raw in enumerate(words):
            word = toxicity.clean_word(raw)
            if word not in known:
                known[word] = _plain_hit(word, model.terms)
            if known[word]:
                sums[3 if _plain_quoted(words, at) else known[word][0]] += known[word][1]
        x = [*(math.log(1 + s) for s in sums), sum(sums[:3]) / (len(words) + 20), math.log(1 + len(words))]
        raw = model.bias + sum(w * (v - c) / s for w, v, c, s in zip(model.weights, x, model.centre, model.scale))
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, raw)))), abs=1e-9), r["doc_id"]
        assert got[r["doc_id"]]["predicted"] == (got[r["doc_id"]]["score"] >= 0.5)
    assert any(known.values())


def test_labels_that_conflict_or_are_of_one_class(spark, tables):
    docs, labels = tables
    ids = [r[0] for r in labels.select("doc_id").collect()]
    some = ids[::7]
    twice = labels.unionAll(labels.where(F.col("doc_id").isin(some)).select("doc_id", (1 - F.col("quality")).alias("quality"), (1 - F.col("toxic")).alias("toxic")))
    larger = labels.select("doc_id", F.when(F.col("doc_id").isin(some), 1).otherwise(F.col("quality")).alias("quality"), F.when(F.col("doc_id").isin(some), 1).otherwise(F.col("toxic")).alias("toxic"))
    a, b = quality.fit(docs, twice), quality.fit(docs, larger)
    assert np.allclose(a.linear, b.linear) and a.bias == b.bias
    assert toxicity.fit(docs, twice) == toxicity.fit(docs, larger)
    one = labels.withColumns({"quality": F.lit(1), "toxic": F.lit(0)})
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, one)).collect()} == {0.5}
    assert all(r["score"] < 1e-9 for r in toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, one)).collect())
