"""Benchmark decontamination by template canonicalisation.

Words lose the punctuation around them and are lower-cased; numbers, units after numbers and names (capitals
inside a sentence) become typed placeholders. Windows of `window` template tokens are hashed, and the windows of documents
are hash-joined with those of the benchmark. Matches of one document and item on one alignment are
one occurrence. A slot conflicts if its item value mostly stands for another value in the occurrence (slot consistency). Up to
a share of `conflicts` of an occurrence's slots, equal item values are taken for separate slots and all windows count; beyond it,
windows with a conflicting slot don't count, unless all their values are the item's. So a question asked again with other names
and numbers is found, also where one number fills two slots by chance, and a chance mixture is not. An item leaks into a document when consistent occurrences cover at least `coverage` of its windows.

A window with fewer than `literals` plain words says little, so its hash also takes the values in its slots. The benchmark's hashes
(eight bytes each) are sent to the tasks only up to BENCHMARK_WINDOWS, to leave out unmatched windows before the join, and its windows with their slots only up to
BENCHMARK_BYTES; beyond that windows are shuffled, with equal results.

Rows are told apart by id and text, on both sides. Defined cases: null text counts as empty; items of fewer than `window` tokens form one
window of all their tokens; items without tokens match nothing; null ids are ids like any other; rows that repeat id and text count once;
different texts of one id are judged alone; extra columns are ignored, and kept by decontaminate() whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.common import free_names, quoted, stored, without

WINDOW, COVERAGE, LITERALS, CONFLICTS = 8, 0.5, 4, 0.5
BENCHMARK_WINDOWS, BENCHMARK_BYTES = 2_000_000, 32 << 20
LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
#: Units of measure that are replaced after a number.
UNITS = frozenset("mm cm m km g kg mg lb lbs oz ml l s sec seconds min minutes h hours days weeks months years % percent € $ £ usd eur dollars euros cents meters metres miles feet inches pounds kilograms grams liters litres degrees km/h mph".split())


class _Words(dict):
    """Code of a raw word; the arrays hold what is known of each code."""

    def __init__(self) -> None:
        self.clear_all()

    def clear_all(self) -> None:
        self.clear()
        self.size = 0
        self.hash, self.kind = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int8)
        self.capital, self.ends, self.unit = (np.zeros(1 << 16, bool) for _ in range(3))

    def __missing__(self, word: str) -> int:
        import xxhash

        code = self.size
        if code == len(self.hash):
            for name in ("hash", "kind", "capital", "ends", "unit"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        core = word
        while core and not (core[-1].isalnum() or core[-1] in "%€$£"):
            core = core[:-1]
        while core and not (core[0].isalnum() or core[0] in "%€$£"):
            core = core[1:]
        plain = core.lower()
        number = plain.lstrip("$€£").replace(",", "").replace(".", "", 1)
        self.kind[code] = -1 if not core else NUMBER if number.isdigit() else LITERAL
        self.hash[code] = xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass"))
        self.capital[code] = core[:1].isupper()
        self.ends[code] = word[-1:] in ".!?:" or word[-2:-1] in ".!?"
        self.unit[code] = plain in UNITS
        self[word] = code
        self.size += 1
        return code


_PLACE = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _template(text: str, words: _Words):
    """raw words, hashes of template tokens, hashes of values, kinds."""
    import re

    if re.search(r"\d[A-Za-z%€$£]", text):
        text = re.sub(r"(?<=\d)(?=[A-Za-z%€$£])", " ", text)
    if words.size > 400_000:
        words.clear_all()
    raw = text.split()
    code = np.fromiter(map(words.__getitem__, raw), np.int64, len(raw))
    kind = words.kind[code]
    if (kind < 0).any():
        real = kind >= 0
        at = np.flatnonzero(real)
        ends = np.r_[True, words.ends[code][:-1]][: at[-1] + 1] if len(at) else np.zeros(0, bool)
        after = np.logical_or.reduceat(ends, np.r_[0, at[:-1] + 1]) if len(at) else ends
        raw = [w for w, r in zip(raw, real.tolist()) if r]
        code, kind = code[real], kind[real]
    else:
        after = np.r_[True, words.ends[code][:-1]] if len(code) else np.zeros(0, bool)
    kind = kind.copy()
    kind[words.capital[code] & ~after & (kind == LITERAL)] = NAME
    if len(kind):
        kind[np.r_[False, kind[:-1] == NUMBER] & words.unit[code]] = UNIT
    value = words.hash[code]
    return raw, np.where(kind == LITERAL, value, _PLACE[kind]), value, kind


def _windows(token, value, kind, width: int, literals: int) -> np.ndarray:
    """The hash of each window."""
    n = len(token) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    low = np.full(n, np.uint64(width))
    full = low.copy()
    for k in range(width):
        low = low * _STEP + token[k : n + k]
        full = full * _STEP + value[k : n + k]
    plain = np.cumsum(np.r_[0, kind == LITERAL])
    few = plain[width:] - plain[:-width] < min(literals, width)
    out = np.where(few, full ^ np.uint64(1), low)
    out ^= out >> np.uint64(29)
    return out * _STEP


_SCHEMA = "id long, digest long, h long, width int, pos int, windows int, slots array<string>, places array<int>"


def template_windows(rows: DataFrame, widths: list[int] | None, window: int = WINDOW, literals: int = LITERALS, only: np.ndarray | None = None) -> DataFrame:
    """id, digest, h, width, pos, windows (of the row), slots, places (of the slots in the window): a row for each window of rows (id, digest, text).

    widths: of documents, all that occur in the benchmark; None for the benchmark itself, where each item has
    one width. only: sorted hashes; other windows are left out.
    """
    bits = None
    if only is not None:
        bits = np.zeros(1 << 22, bool)
        bits[only >> np.uint64(42)] = True
    sent = rows.sparkSession.sparkContext.broadcast((only, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (wanted, quick) = _Words(), sent.value
        for batch in batches:
            out: list[tuple] = []
            for i, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw, token, value, kind = _template(text.as_py() or "", words)
                for width in widths if widths is not None else [min(window, len(raw))] * bool(raw):
                    h = _windows(token, value, kind, width, literals)
                    if wanted is None:
                        at = np.arange(len(h))
                    else:
                        at = np.flatnonzero(quick[h >> np.uint64(42)])
                        if len(at):
                            near = np.searchsorted(wanted, h[at])
                            at = at[wanted[np.minimum(near, len(wanted) - 1)] == h[at]]
                    for p, x in zip(at.tolist(), h[at].view(np.int64).tolist()):
                        places = np.flatnonzero(kind[p : p + width] != LITERAL).tolist()
                        slots = [f"{'lnuN'[kind[p + k]]}:{raw[p + k].strip('.,;:!?()').lower()}" for k in places]
                        out.append((i, digest, x, width, p, len(h), slots, places))
                    if len(out) > 50_000:
                        yield _rows(out)
                        out = []
            yield _rows(out)

    return rows.mapInArrow(run, _SCHEMA)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, kinds)], ["id", "digest", "h", "width", "pos", "windows", "slots", "places"])


def counted_windows(windows: list[tuple], conflicts: float = CONFLICTS) -> list[tuple[int, bool]]:
    """at, other (any value is not the item's) of the windows of one occurrence that count.

    windows: at and slots (place in the item, item value, document value) of each.
    """
    stands: dict = defaultdict(Counter)
    for _, i, d in (slots := {tuple(s) for _, window in windows for s in window}):
        stands[i][d] += 1
    most = {i: max(c, key=lambda d: (c[d], d == i, d)) for i, c in stands.items()}
    few = sum(d != most[i] for _, i, d in slots) <= conflicts * len(slots)
    out = []
    for at, window in windows:
        other = any(i != d for _, i, d in window)
        if few or not other or all(d == most[i] for _, i, d in window):
            out.append((at, other))
    return out


def _counted(conflicts: float):
    """Leaves in ats the windows that count, and says whether one of them has another value. matched is null where no value differs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats, other = [], []
            for at, matched in zip(batch.column("ats"), batch.column("matched")):
                if not matched.is_valid:
                    ats.append(at.as_py())
                    other.append(False)
                    continue
                windows = [(w["at"], [(s["place"], s["i"], s["d"]) for s in w["slots"]]) for w in matched.as_py()]
                stay = counted_windows(windows, conflicts)
                ats.append(sorted({a for a, _ in stay}))
                other.append(any(o for _, o in stay))
            rest = batch.select([n for n in batch.schema.names if n not in ("ats", "matched")])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(ats, pa.list_(pa.int32())), pa.array(other, pa.bool_())], [*rest.schema.names, "ats", "other"])

    return run


def _keyed(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"), F.col(text_col).alias("text"))


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, window: int, coverage: float, literals: int, conflicts: float) -> DataFrame:
    """What find_leaks() returns, with the digest of the document's text."""
    items = _keyed(benchmark, item_col, item_text_col).dropDuplicates(["id", "digest"])
    theirs = stored(template_windows(items, None, window, literals), "benchmark")
    theirs = theirs.select(F.col("id").alias("item_id"), F.col("digest").alias("item"), "h", "width", F.col("pos").alias("at"), F.col("windows").alias("item_windows"), F.col("slots").alias("theirs"), F.col("places").alias("item_places"))
    size = theirs.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("theirs", "")) + 32 * F.size("theirs") + 64).alias("bytes"), F.sort_array(F.collect_set("width")).alias("widths")).first()
    only = None
    if size["n"] <= BENCHMARK_WINDOWS:
        only = np.unique(theirs.select("h").toArrow().column(0).to_numpy().view(np.uint64)) if size["n"] else np.array([0], np.uint64)
    if (size["bytes"] or 0) <= BENCHMARK_BYTES:
        theirs = F.broadcast(theirs)
    ours = template_windows(_keyed(docs, id_col, text_col), size["widths"], window, literals, only)
    hits = ours.withColumnRenamed("id", "doc_id").join(theirs, ["h", "width"])
    # where the places differ (a capital in one text alone), the hashes are those of the values, and all values are equal
    slots = F.transform(F.arrays_zip("places", "theirs", "slots"), lambda s: F.struct((s["places"] + F.col("at")).alias("place"), s["theirs"].alias("i"), s["slots"].alias("d")))
    pair = ["doc_id", "digest", "item_id", "item"]
    runs = hits.groupBy(*pair, (F.col("pos") - F.col("at")).alias("shift")).agg(F.collect_set(F.struct("at", F.when(F.col("places") == F.col("item_places"), slots).otherwise(F.slice(slots, 1, 0)).alias("slots"))).alias("matched"), F.first("item_windows").alias("item_windows"))
    differ = F.exists("matched", lambda w: F.exists(w["slots"], lambda s: s["i"] != s["d"]))
    # where all values are the item's, all windows count: only other occurrences need their slots
    runs = runs.select(*pair, "item_windows", F.array_distinct("matched.at").alias("ats"), F.when(F.coalesce(differ, F.lit(True)), F.col("matched")).alias("matched"))
    runs = runs.mapInArrow(_counted(conflicts), ", ".join(f"{n} {t}" for n, t in runs.drop("matched").dtypes) + ", other boolean")
    found = runs.select(*pair, "item_windows", "other", F.explode("ats").alias("at")).groupBy(*pair).agg(F.count_distinct("at").alias("matched_windows"), F.first("item_windows").cast("long").alias("item_windows"), F.max("other").alias("reparameterised"))
    found = found.withColumn("coverage", F.col("matched_windows") / F.col("item_windows")).where(F.col("coverage") >= coverage)
    return found.select("doc_id", "item_id", "matched_windows", "item_windows", "coverage", "reparameterised", "digest")


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE, literals: int = LITERALS, conflicts: float = CONFLICTS) -> DataFrame:
    """doc_id, item_id, matched_windows, item_windows, coverage, reparameterised of each leaked item."""
    return _leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, window, coverage, literals, conflicts).drop("digest")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE, literals: int = LITERALS, conflicts: float = CONFLICTS) -> DataFrame:
    """docs without those that any item leaks into, all columns as they were."""
    on = free_names(docs.columns, "own_id", "own_digest")
    leaks = _leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, window, coverage, literals, conflicts)
    leaks = leaks.select(F.col("doc_id").alias(on[0]), F.col("digest").alias(on[1]))
    keyed = docs.withColumns({on[0]: F.col(id_col).cast("long"), on[1]: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    return without(keyed, leaks, on).select(*quoted(docs.columns))
