"""Personal data by candidate gradient boosting.

Exact patterns give the base spans, which always stay. High-recall generators propose more: e-mail addresses written out,
numbers with other separators, IPv6 addresses, account and social security numbers, secrets after a key word. Their spans may overlap. Each
candidate gets features of its format and of the words around it; boosted trees score it, a threshold per kind,
calibrated for PRECISION on examples kept out of the fit, selects, and of overlapping selected candidates the likeliest stays. Candidates that
overlap a base span are left out. The trees are fitted on EXAMPLES generated examples from a fixed seed, so they learn nothing from
the documents that they redact.

Base patterns are applied leftmost and without overlap for each kind, a match that fails its check is dropped without
another try, and all scans are linear in the length of the text.

Defined cases: null text counts as empty; empty texts have no spans; places are code points; repeated rows are all returned; a
null doc_id is kept; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
EXAMPLES, TREES, LEAVES_DEPTH, RATE, PRECISION = 6000, 60, 3, 0.2, 0.97
CONTEXT = 32

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Runs before each @ instead of a search from every character, which long words would make quadratic."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            found.append((start, free))
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as in KINDS and then by start."""
    spans = [("email", *s) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        spans += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _only_digits(m[0])
                if 16 <= len(digits) <= 19 and luhn(digits):
                    spans.append(("card", m.start(), m.end()))
        if "+" in text:
            spans += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_only_digits(m[0])) <= 15]
    return spans


_GENERATORS = [
    ("email", re.compile(r"(?<![\w.])[\w.+-]{1,64}(?: ?[\[(] ?(?:at|@) ?[\])] ?[\w-]{1,64}(?: ?[\[(]? ?(?:\bdot\b|\.) ?[\])]? ?[a-z]{2,12}\b){1,3}| at [\w-]{1,64}(?: ?[\[(]? ?\bdot\b ?[\])]? ?[a-z]{2,12}\b){1,3})", re.I | re.A), ("dot", "DOT", "Dot", "(at", "[at", "(AT", "[AT", "( at", "[ at", "(@", "[@")),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){2,7}:?[0-9A-Fa-f]{1,4}(?:::?[0-9A-Fa-f]{1,4}){0,6}(?![\w:])", re.A), (":",)),
    ("card", re.compile(r"(?<![\w.])[0-9]{4}([ ./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![\w])|(?<![\w.+-])[0-9]{13,19}(?![\w])", re.A), ()),
    ("phone", re.compile(r"(?<![\w.+-])\(?[0-9]{2,5}\)?(?:[ ./-]\(?[0-9]{2,5}\)?){1,5}(?![\w])", re.A), ()),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", re.A), ()),
    ("ssn", re.compile(r"(?<![\w.-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![\w-])", re.A), ()),
    ("secret", re.compile(r"(?:key|token|secret|passw(?:or)?d|pwd|bearer|auth)\w{0,16}[\"']?\s{0,3}[:=]?\s{0,3}[\"']?([A-Za-z0-9_+/=.-]{12,128})", re.I | re.A), ("key", "oken", "OKEN", "KEY", "ecret", "ECRET", "pass", "PASS", "Pass", "pwd", "earer", "auth", "Auth", "Key")),
]
#: Words that announce a kind.
_WORDS = {
    "email": frozenset("email e-mail mail contact write reach courriel correo".split()),
    "ip": frozenset("ip ipv4 ipv6 address host server addr".split()),
    "card": frozenset("card visa mastercard credit debit payment amex karte tarjeta carte".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax telefon tél teléfono whatsapp".split()),
    "iban": frozenset("iban account bank konto compte cuenta transfer".split()),
    "ssn": frozenset("ssn social security insurance".split()),
    "secret": frozenset("key token secret password passwd pwd bearer auth api".split()),
}
_AGAINST = frozenset("order version page isbn item invoice chapter section id ref number no total date lines sku build ticket".split())
FEATURES = ["length", "digits", "letters", "upper", "separators", "kinds_of_separator", "entropy", "hex", "luhn", "announced", "any_announced", "against", "quoted", "assigned", "digit_before", "digit_after", "first_group", "last_group", "parts", "letters_and_digits", "known_end"]


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans, which may overlap; a pattern is tried only where its marks occur."""
    digits = bool(_DIGIT.search(text))
    found = []
    for kind, pattern, marks in _GENERATORS:
        if (any(m in text for m in marks) if marks else digits) and (kind != "ip" or text.count(":") > 2):
            found += [(kind, *(m.span(1) if kind == "secret" else m.span())) for m in pattern.finditer(text)]
    return found


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Kind, format of the span and words around it."""
    span, left, right = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    n = len(span)
    digit, letter = sum(c.isdigit() for c in span), sum(c.isalpha() for c in span)
    marks = [c for c in span if not c.isalnum()]
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(span).values()) if n else 0
    words = [w.strip(".,:;=()[]\"'").lower() for w in (left + " " + right).split()]
    near = words[max(0, len(left.split()) - 4) : len(left.split()) + 1]
    groups = re.split(r"[^0-9A-Za-z]+", span)
    digits = _only_digits(span)
    return [
        float(KINDS.index(kind)), n, digit / max(1, n), letter / max(1, n), sum(c.isupper() for c in span) / max(1, n), len(marks), len(set(marks)), entropy, sum(c in "0123456789abcdefABCDEF" for c in span) / max(1, n),
        bool(13 <= len(digits) <= 19 and luhn(digits)), any(w in _WORDS[kind] for w in near), any(w in s for s in _WORDS.values() for w in words), any(w in _AGAINST for w in near),
        left[-1:] in "\"'" and bool(left), left.rstrip(" \"'")[-1:] in (":", "="), left.rstrip()[-1:].isdigit(), right.lstrip()[:1].isdigit(), len(groups[0]), len(groups[-1]), len(groups), min(digit, letter) / max(1, n),
        span.lower().rstrip(".").endswith((".com", ".org", ".net", ".edu", ".io", "com", "org", "net", ".de", ".fr", ".es")),
    ]


def _examples(count: int, seed: int) -> list[tuple[str, str, int, int, int]]:
    """Generated texts with one candidate each: (text, kind, start, end, is personal)."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(str(d) for d in rng.integers(0, 10, k))
    chars = lambda k, pool="abcdefghijklmnopqrstuvwxyz": "".join(pick(pool) for _ in range(k))
    hexes, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    prose = lambda: " ".join(chars(int(rng.integers(2, 9))) for _ in range(int(rng.integers(0, 5))))

    def card(valid: bool) -> str:
        d = digits(15)
        last = next(c for c in "0123456789" if luhn(d + c) == valid)
        return pick([" ", "-", ".", "/"]).join((d + last)[i : i + 4] for i in range(0, 16, 4))

    def made(kind: str, true: bool) -> tuple[str, str]:
        """The span and what leads to it."""
        lead = pick([f"{pick(sorted(_WORDS[kind]))}: ", f"{pick(sorted(_WORDS[kind]))} ", f"{prose()} "]) if true else pick([f"{prose()} ", f"{pick(sorted(_AGAINST))} ", f"{pick(sorted(_AGAINST))}: "])
        if kind == "email":
            return (f"{chars(6)} {pick(['at', '(at)', '[at]', 'AT'])} {chars(7)} {pick(['dot', '[dot]', '(dot)'])} {pick(['com', 'org', 'net', 'de'])}", lead) if true else (f"{chars(5)} at {chars(3)} dot {chars(int(rng.integers(4, 9)))}", lead)
        if kind == "ip":
            return (":".join(chars(4, hexes) for _ in range(8)), lead) if true else (":".join(digits(2) for _ in range(int(rng.integers(3, 5)))), lead)
        if kind == "card":
            return (card(True), lead) if true else (pick([card(False), digits(int(rng.integers(13, 20)))]), lead)
        if kind == "phone":
            lead = f"{pick(sorted(_WORDS[kind]))}{pick([': ', ' ', '. '])}" if true else lead
            return (pick([f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"0{digits(3)} {digits(3)} {digits(3)}"]), lead) if true else (pick([f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(3)} {digits(3)}", f"{digits(4)}/{digits(2)}"]), lead)
        if kind == "iban":
            return (pick(["DE", "FR", "ES", "GB"]) + digits(2) + "".join(f" {digits(4)}" for _ in range(4)) + f" {digits(2)}", lead) if true else (chars(2, "ABXY") + digits(2) + chars(8, "ABCDEFGH0123"), lead)
        if kind == "ssn":
            return (f"{digits(3)}-{digits(2)}-{digits(4)}", f"{pick(sorted(_WORDS[kind]))}: ") if true else (f"{digits(3)}-{digits(2)}-{digits(4)}", lead)
        lead = f'{prose()} {pick(["token", "api_key", "secret", "password", "auth_token"])} {pick(["= ", ": ", "="])}{pick(["", chr(34)])}'
        return (chars(int(rng.integers(20, 48)), pick([hexes, mixed])), lead) if true else (chars(int(rng.integers(12, 16))), f"{prose()} {pick(['key', 'token', 'secret'])} ")

    out = []
    for i in range(count):
        kind, true = KINDS[i % len(KINDS)], bool(rng.integers(2))
        span, lead = made(kind, true)
        text = f"{prose()} {lead}"
        out.append((f"{text}{span}{pick(['', '.', ',', chr(34)])} {prose()}", kind, len(text), len(text) + len(span), int(true)))
    return out


class BoostedTrees:
    """Regression trees of fixed depth on the gradient of log loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = LEAVES_DEPTH, rate: float = RATE) -> None:
        self.start = math.log(y.mean() / (1 - y.mean()))
        raw = np.full(len(y), self.start)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 24)[1:-1])) for c in x.T]
        self.trees: list[tuple[list[tuple[int, float]], np.ndarray]] = []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            self.trees.append(self._grow(x, y - p, p * (1 - p), cuts, depth, rate))
            raw += self._apply(x, *self.trees[-1])

    @staticmethod
    def _grow(x, gradient, curve, cuts, depth, rate):
        """All nodes of a level split in the same place, the one with the largest gain."""
        node, splits = np.zeros(len(x), np.int64), []
        for level in range(depth):
            best = (-1.0, 0, 0.0)
            for f, places in enumerate(cuts):
                for cut in places:
                    side = node * 2 + (x[:, f] > cut)
                    g, h = np.bincount(side, gradient, 2 << level), np.bincount(side, curve, 2 << level)
                    best = max(best, (float((g**2 / (h + 1)).sum()), f, float(cut)))
            splits.append(best[1:])
            node = node * 2 + (x[:, best[1]] > best[2])
        g, h = np.bincount(node, gradient, 1 << depth), np.bincount(node, curve, 1 << depth)
        return splits, rate * g / (h + 1)

    @staticmethod
    def _apply(x, splits, leaves):
        node = np.zeros(len(x), np.int64)
        for f, cut in splits:
            node = node * 2 + (x[:, f] > cut)
        return leaves[node]

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = self.start + sum(self._apply(x, *t) for t in self.trees)
        return 1 / (1 + np.exp(-raw))


def fit(examples: int = EXAMPLES, seed: int = 17) -> tuple[BoostedTrees, dict[str, float]]:
    """The trees and each kind's threshold, the lowest that gives PRECISION on a third of the examples kept out of the fit."""
    made = _examples(examples, seed)
    x, y = np.array([features(*e[:4]) for e in made], float), np.array([e[4] for e in made])
    own = np.arange(len(y)) // len(KINDS) % 3 > 0
    trees = BoostedTrees(x[own], y[own])
    p, thresholds = trees.probability(x[~own]), {}
    for k, kind in enumerate(KINDS):
        mine = x[~own][:, 0] == k
        order = np.argsort(-p[mine])
        right = np.cumsum(y[~own][mine][order]) / np.arange(1, mine.sum() + 1)
        good = np.flatnonzero(right >= PRECISION)
        thresholds[kind] = max(0.5, float(p[mine][order][good[-1]])) if len(good) else 1.1
    return trees, thresholds


class Spans:
    """Disjoint spans in order; of overlapping ones their union."""

    def __init__(self, spans) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at == 0 or self.ends[at - 1] <= start

    def add(self, start: int, end: int) -> None:
        """A span that is free."""
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)


def select(text: str, base: list[tuple[str, int, int]], trees: BoostedTrees, thresholds: dict[str, float]) -> list[tuple[str, int, int]]:
    """Candidates that pass, without overlaps among themselves or with base."""
    covered = Spans((s, e) for _, s, e in base)
    proposed = [c for c in candidates(text) if covered.free(*c[1:])]
    likely: list[tuple[float, int]] = []
    for at in range(0, len(proposed), 4096):
        p = trees.probability(np.array([features(text, *c) for c in proposed[at : at + 4096]], float))
        likely += [(-v, at + i) for i, v in enumerate(p.tolist()) if v >= thresholds[proposed[at + i][0]]]
    taken, out = Spans(()), []
    for _, i in sorted(likely):
        if taken.free(*proposed[i][1:]):
            taken.add(*proposed[i][1:])
            out.append(proposed[i])
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple[BoostedTrees, dict[str, float]] | None = None) -> DataFrame:
    """doc_id, base and spans (kind:start:end, joined), and counts of base spans by kind of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model or fit())
    names = ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base", "spans"]
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, thresholds = sent.value
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                counts = Counter(k for k, _, _ in base)
                rows.append((*(counts[k] for k in KINDS[:4]), _joined(base), _joined(base + select(text, base, trees, thresholds))))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2))], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def redact(text: str, spans: str) -> str:
    """text with every span replaced by its kind in brackets."""
    found = sorted(((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x)), reverse=True)
    last = len(text) + 1
    for s, e, k in found:
        if e <= last:
            text, last = f"{text[:s]}[{k.upper()}]{text[e:]}", s
    return text


def base_digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
