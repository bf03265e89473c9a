"""Edit-aware token counts over pre-token segment trees.

A document is cut, where the pre-tokenizer allows it, into segments of about SEGMENT pre-token parts. The segments are the leaves of
a segment tree whose nodes hold the characters and tokens below them. An edit finds its leaves by descending over
the character sums, and only their text is encoded again, with one leaf more on a side whose boundary the edit may have
changed; sums are then updated on the paths to the root.

Defined cases: null text counts as empty and has no tokens; edits beyond the text are cut off at its end; null edit lists
and empty texts are left as they are; repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.tokens import PartEncoder, vocabulary_path

SEGMENT = 24


class SegmentTree:
    """Leaves of text; heap-ordered sums of their characters and tokens."""

    def __init__(self, text: str, encoder: PartEncoder) -> None:
        self.encoder, self.encoded = encoder, 0
        if len(encoder) > 300_000:
            encoder.clear()
        units = encoder.units(text)
        self.leaf: list[str] = []
        counts: list[int] = []
        for at in range(0, len(units), SEGMENT):
            part = units[at : at + SEGMENT]
            self.leaf.append("".join(p if p[:1] == "\n" or not at and not i else " " + p for i, p in enumerate(part)))
            counts.append(self._tokens(part, first=not at))
        self.encoded = 0
        self.width = 1 << max(0, (len(self.leaf) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, t in enumerate(self.leaf):
            self.chars[self.width + i], self.tokens[self.width + i] = len(t), counts[i]
        for node in range(self.width - 1, 0, -1):
            self._sum(node)

    def _tokens(self, units: list[str], first: bool) -> int:
        size = len(self.encoder.whole(units[0])) if first and units[0] else 0
        return (size + sum(map(len, map(self.encoder.__getitem__, units[1:] if first else units)))) // 4

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character place, and the place inside it."""
        node = 1
        while node < self.width:
            node *= 2
            if char >= self.chars[node] and self.chars[node + 1]:
                char -= self.chars[node]
                node += 1
        return node - self.width, char

    def _set(self, leaf: int, text: str) -> None:
        self.leaf[leaf] = text
        self.encoded += len(text)
        node = self.width + leaf
        self.chars[node] = len(text)
        self.tokens[node] = len(self.encoder.whole(text)) // 4 if text else 0
        while node > 1:
            node //= 2
            self._sum(node)

    def _safe(self, after: str) -> bool:
        """Whether the text before can be encoded without this one."""
        return len(after) > 1 and after[0] in " \n" and not after[1].isspace() and not after.startswith(self.encoder.special, 1)

    def edit(self, start: int, end: int, text: str) -> None:
        """Replaces characters start .. end by text."""
        size = self.chars[1]
        start, end = min(max(0, start), size), min(max(start, end), size)
        a, at = self._find(start)
        b, to = self._find(end)
        new = self.leaf[a][:at] + text + self.leaf[b][to:]
        before = a - 1
        while True:  # to the left, until the new text may begin a leaf
            while before >= 0 and not self.leaf[before]:
                before -= 1
            if before < 0 or self._safe(new):
                break
            new, a, before = self.leaf[before] + new, before, before - 1
        after = b + 1
        while True:  # to the right, until the leaf there may still begin one
            while after < len(self.leaf) and not self.leaf[after]:
                after += 1
            if after == len(self.leaf) or self._safe(self.leaf[after]):
                break
            new, b, after = new + self.leaf[after], after, after + 1
        for leaf in range(a + 1, b + 1):
            self._set(leaf, "")
        self._set(a, new)


def count_edits(docs: DataFrame, edits_col: str = "edits", id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_chars_edited, n_chars_encoded of each row.

    edits_col: array of structs (start, end, text), in characters of the text that earlier edits leave; applied in order.
    """
    path = vocabulary or vocabulary_path()
    schema = "doc_id long, n_tokens long, n_tokens_edited long, n_chars_edited long, n_chars_encoded long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PartEncoder(path)
        for b in batches:
            rows = []
            texts = [t.as_py() or "" for t in b.column(1)]
            for at, (text, edits) in enumerate(zip(texts, b.column(2))):
                if at % 256 == 0:
                    encoder.learn({u for t in texts[at : at + 256] for u in encoder.units(t)[1:]})
                tree = SegmentTree(text, encoder)
                before = tree.tokens[1]
                for e in edits.as_py() or []:
                    tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                rows.append((before, tree.tokens[1], tree.chars[1], tree.encoded))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_encoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(edits_col).alias("edits")).mapInArrow(run, schema)


def review_edits(text):
    """Three edits of a review: the first 16 characters go, a mark replaces 12 in the middle, and a closing line is added."""
    size = F.length(F.coalesce(text, F.lit("")))
    edit = lambda a, b, t: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(t).alias("text"))
    left = F.greatest(size - 16, F.lit(0))
    middle = F.floor(left / 2)
    return F.array(edit(F.lit(0), F.lit(16), ""), edit(middle, middle + 12, " [removed] "), edit(size + 64, size + 64, "\nEnd of document."))
