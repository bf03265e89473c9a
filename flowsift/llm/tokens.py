"""Byte-pair token ids of texts, with a cache of space-delimited parts.

The pre-tokenizer of the byte-level vocabularies gives a run of white space all but its last character, so a text can be cut
before any space or newline that other characters follow; its ids are those of the parts put one after another. Parts that are
not in the cache yet are joined and encoded at once, and the ids are dealt out by their length in bytes.

The vocabulary is a file of the `tokenizers` library (byte-level BPE whose ids follow the order of its merges); its table is
handed to `tiktoken`, which gives the same ids in a third of the time. Texts that `tiktoken` would take otherwise, those with an added token of the
vocabulary, or can't take, those with a run of white space of LONG_SPACE characters or more, go to `tokenizers` itself.

Defined cases: empty text has no ids; texts of any length are encoded whole; surrogates count as the replacement character; the cache is emptied when CACHED_PARTS parts are known.
"""

from __future__ import annotations

import json
import re

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
CACHED_PARTS = 300_000
LONG_SPACE = 1024


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself if it can be printed, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PartEncoder(dict):
    """Maps a part (without the space before it) to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        super().__init__()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        self.path, self.plain = path, None
        special = {t["content"] for t in vocabulary["added_tokens"]}
        self.special = tuple(sorted(special))
        self.cuts = re.compile(f"(?=[ \n]{''.join(f'(?!{re.escape(x)})' for x in self.special)}\\S)")
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary["model"]["vocab"].items() if token not in special}
        self.bpe = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)

    def is_hard(self, text: str) -> bool:
        """Whether text has an added token or a run of white space that covers an aligned half of LONG_SPACE."""
        step = LONG_SPACE // 2
        return any(x in text for x in self.special) or len(text) >= step and any(c.isspace() and text[i * step : (i + 1) * step].isspace() for i, c in enumerate(text[::step]))

    def whole(self, text: str) -> bytes:
        try:
            if not self.is_hard(text):
                return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()
            if self.plain is None:
                from tokenizers import Tokenizer

                self.plain = Tokenizer.from_file(self.path)
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        except UnicodeEncodeError:
            return self.whole(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"))

    def learn(self, parts: set[str]) -> None:
        """Encodes parts that are not yet known, all at once."""
        new = [p for p in parts if p not in self]
        if len(self) + len(new) > CACHED_PARTS:
            self.clear()
            new = list(parts)
        if not new:
            return
        for p in [p for p in new if self.is_hard(p)]:
            self[p] = self.whole(p if p[:1] == "\n" else " " + p)
        new = [p for p in new if p not in self]
        spelled = [p if p[:1] == "\n" else " " + p for p in new]
        ids = np.array(self.bpe.encode_ordinary("".join(spelled)), "<u4")
        ends = np.cumsum([len(p.encode()) for p in spelled])
        cuts = [0, *(4 * (np.searchsorted(np.cumsum(self.size[ids]), ends) + 1)).tolist()]
        data = ids.tobytes()
        self.update(zip(new, (data[a:b] for a, b in zip(cuts, cuts[1:]))))

    def __missing__(self, part: str) -> bytes:
        ids = self[part] = self.whole(part if part[:1] == "\n" else " " + part)
        return ids

    def units(self, text: str) -> list[str]:
        """text in parts whose ids are independent; parts but the first begin with a space, left out, or a newline."""
        if self.is_hard(text):
            first, *parts = self.cuts.split(text)
            return [first, *(p.removeprefix(" ") for p in parts)]
        parts = text.replace("\n", " \n").split(" ")
        if not any(map(_joins, parts[1:])):
            return parts
        out = [parts[0]]
        for p in parts[1:]:
            if _joins(p):
                out[-1] += p if p[:1] == "\n" else " " + p
            else:
                out.append(p)
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; texts are best passed in batches of a few MB."""
        cut = [self.units(t) for t in texts]
        self.learn({u for units in cut for u in units[1:]})
        return [(self.whole(units[0]) if units[0] else b"") + b"".join(map(self.__getitem__, units[1:])) for units in cut]


def _joins(part: str) -> bool:
    """Whether a part belongs to the white space before it."""
    return not part or part[0].isspace() and (part[0] != "\n" or len(part) == 1 or part[1].isspace())
