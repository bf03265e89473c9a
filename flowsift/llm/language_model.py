"""Byte-level context-tree weighting, beside the plain unigram score of a text.

A text is its lower-cased words joined by single spaces and one end byte. Each byte is eight binary decisions, and every
node of a context tree (the 0 to DEPTH bytes before) has Krichevsky-Trofimov counts for each of them. A node's block
probability is half its own estimate plus half the product of its children's, so the training counts alone fix the
weight of every depth, and a prediction is the weighted mixture of the estimates of all depths. Where a context has never met a
decision, its parent's estimate stands. The model's score is the log10 probability of all bytes.

Texts are dealt to chunks of about CHUNK_BYTES by a hash of id and text. A chunk sends its distinct windows of DEPTH + 1 bytes and its
distinct words (their XXH64), with training counts, to buckets: windows by a hash of the PREFIX bytes before the last, words by their own. A bucket sums
them over the corpus and has all contexts from its nodes of depth PREFIX down, so what one task must hold together is at most the
2**24 windows of one context of four bytes. The counts and block probabilities of these nodes go up to the nodes of depth 2, from there to
the 256 of depth 1 and to the root, in three small aggregations, and the mixture of the upper depths comes back to the buckets as two
numbers for each node and decision. With them, a bucket answers each chunk for just what it sent. A bucket merges a few chunks at
a time and holds its distinct windows, sparsely: memory is in proportion to them.

Defined cases: null text counts as empty and has the end token alone; a null doc_id folds as empty text; repeated rows
each count and are all returned, but rows that agree in id and text share a chunk; with no training rows every probability is that of empty counts; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.common import fold

DEPTH, PREFIX = 6, 4
CHUNK_BYTES = 8 << 20
SLICE = 1 << 20
MERGED = 16
END = b"\n"
_TABLE = np.array([math.lgamma(k + 0.5) for k in range(4096)]), np.array([math.lgamma(k + 1.0) for k in range(8192)])


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _gamma_log(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)


def kt_block_log(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    n = zeros + ones
    if not n.size or n.max() < 4096:
        return _TABLE[0][zeros] + _TABLE[0][ones] - _TABLE[1][n] - math.log(math.pi)
    half = lambda k: np.where(k < 4096, _TABLE[0][np.minimum(k, 4095)], _gamma_log(k + 0.5))
    return half(zeros) + half(ones) - np.where(n < 8192, _TABLE[1][np.minimum(n, 8191)], _gamma_log(n + 1.0)) - math.log(math.pi)


def mixed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
    """Of nodes with these counts and children's block logs: estimate of a one, own share against the children, block log."""
    own = kt_block_log(zeros.astype(np.int64), ones.astype(np.int64))
    share = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))
    return (ones + 0.5) / (zeros + ones + 1.0), share, math.log(0.5) + np.logaddexp(own, below)


def _packed(x: np.ndarray) -> bytes:
    """Sorted codes as byte planes of their differences, which compress."""
    return np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _packed_counts(n: np.ndarray) -> bytes:
    """Counts as byte planes, of which the upper ones compress to nothing."""
    return n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked_counts(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def window_codes(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows, the nearest context byte highest and the predicted byte lowest, and the text of each."""
    buf = np.frombuffer(b"".join(END * depth + t + END for t in texts), np.uint8)
    size = np.array([len(t) + depth + 1 for t in texts])
    n = len(buf) - depth
    code = np.zeros(n, np.uint64)
    for k in range(1, depth + 1):
        code = (code << np.uint64(8)) | buf[depth - k : depth - k + n]
    code = (code << np.uint64(8)) | buf[depth:]
    own = np.repeat(np.arange(len(texts), dtype=np.int32), size)
    real = np.ones(len(buf), bool)
    for k in range(depth):  # windows that end in what stands before a text
        real[np.cumsum(size) - size + k] = False
    real = real[depth:]
    return code[real], own[depth:][real]


class Lookup:
    """Values by 64-bit key, in an open-addressing table probed for many keys at once; absent keys give 0."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        self.keys, self.values, used = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, values.dtype), np.zeros(1 << self.bits, bool)
        at, todo = self._place(keys), np.arange(len(keys))
        while len(todo):
            free = ~used[at]
            spot, first = np.unique(at[free], return_index=True)
            mine = todo[free][first]
            self.keys[spot], self.values[spot], used[spot] = keys[mine], values[mine], True
            left = np.ones(len(todo), bool)
            left[np.flatnonzero(free)[first]] = False
            todo, at = todo[left], (at[left] + 1) & ((1 << self.bits) - 1)
        self.used = used

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        out = self.values[at]
        off = np.flatnonzero(self.keys[at] != keys)
        at = at[off]
        while len(off):
            at = (at + 1) & ((1 << self.bits) - 1)
            same = self.keys[at] == keys[off]
            out[off[same]] = self.values[at[same]]
            more = ~same & self.used[at]
            off, at = off[more], at[more]
        return out


def _slices(texts: pa.ChunkedArray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE bytes."""
    size = np.cumsum(np.concatenate([pc.binary_length(c).to_numpy(zero_copy_only=False) for c in texts.chunks] or [np.zeros(0)]))
    begin = 0
    while begin < len(size):
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + SLICE, "right")))
        yield begin, end
        begin = end


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    if not held:
        return [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    code, n = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(code)
    code, n = code[order], n[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
    return [(code[first], np.add.reduceat(n, first) if len(first) else n)]


def _gathered(held: list, code: np.ndarray, skip: np.ndarray) -> list:
    """held with the distinct windows of one slice more; those that are skipped count 0."""
    held.append(np.unique(code[~skip], return_counts=True))
    u = np.unique(code[skip])
    held.append((u, np.zeros(len(u), np.int64)))
    return _merged(held) if len(held) >= 8 else held


def _by_bucket(code: np.ndarray, depth: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each window, and the order of windows by bucket."""
    bucket = _context_bucket(code >> np.uint64(8 * (depth + 1 - PREFIX)), buckets)
    return bucket, np.argsort(bucket, kind="stable")


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array(list(map(xxhash.xxh64_intdigest, [*words, END])), np.uint64)


def _context_bucket(context: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of the context bytes nearest to the predicted one."""
    return ((context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(buckets)


def _reader(depth: int, chunks: int):
    """Chunk to one row (chunk, bucket, kind, key, n) for each bucket and kind: "g" windows, "w" words."""

    def send(key, table):
        out = table.column("held_out").to_numpy()
        held, hashes = [], []
        for begin, end in _slices(table.column("text")):
            words = [_words(t.as_py()) for t in table.column("text")[begin:end]]
            away = out[begin:end]
            hashes.append((h := [_hashes(w) for w in words]) and (np.concatenate(h), np.repeat(~away, [len(x) for x in h])))
            code, own = window_codes([b" ".join(w) for w in words], depth)
            del words, h
            held = _gathered(held, code, away[own])
        code, n = _merged(held)[0]
        bucket, order = _by_bucket(code, depth, chunks)
        cuts = np.searchsorted(bucket[order], np.arange(chunks + 1, dtype=np.uint64))
        rows = [("g", _packed(code[at]), _packed_counts(n[at])) for at in (order[a:b] for a, b in zip(cuts, cuts[1:]))]
        u, at = np.unique(np.concatenate([h[0] for h in hashes]), return_inverse=True)
        n = np.bincount(at, np.concatenate([h[1] for h in hashes]), len(u))
        cuts = np.r_[0, np.searchsorted(u, _edges(chunks)), len(u)]
        rows += [("w", _packed(u[a:b]), _packed_counts(n[a:b])) for a, b in zip(cuts, cuts[1:])]
        kind, keys, counts = zip(*rows)
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(rows), pa.int32()), "bucket": pa.array([*range(chunks)] * 2, pa.int32()), "kind": pa.array(kind), "key": pa.array(keys, pa.binary()), "n": pa.array(counts, pa.binary())})

    return send


def _edges(chunks: int) -> np.ndarray:
    width = -(-(1 << 64) // chunks)
    return np.array([width * k for k in range(1, chunks)], np.uint64)


def _all_windows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The windows that all chunks sent, merged MERGED chunks at a time."""
    held: list = []
    for key, n in zip(table.column("key"), table.column("n")):
        held.append((_unpacked(key.as_py()), _unpacked_counts(n.as_py()).astype(np.int64)))
        if len(held) >= MERGED:
            held = _merged(held)
    return _merged(held)[0]


class Tree:
    """The contexts of sorted windows from depth down to PREFIX, a node for each context and decision on the path of a byte.

    keys: (context << 8 | decision) of the nodes of depth PREFIX, sorted, with their zeros, ones and block logs. node[b] and deep[b]: of
    each window the node (its place in keys) of its decision b, and the prediction of a one there from this depth down.
    """

    def __init__(self, code: np.ndarray, n: np.ndarray, depth: int) -> None:
        levels = [(code, n.astype(np.float64), None)]  # windows of each depth, their counts, and to which one those of the depth before belong
        for _ in range(depth - PREFIX):
            code, n, _ = levels[-1]
            up, to = np.unique(code >> np.uint64(16) << np.uint64(8) | code & np.uint64(255), return_inverse=True)
            levels.append((up, np.bincount(to, n, len(up)), to))
        found, self.node, self.deep = [], [], []
        for b in range(8):
            at, deep, seen, block, first = None, None, None, None, None
            for code, n, to in levels:
                top = code >> np.uint64(8 - b)
                new = np.r_[True, top[1:] != top[:-1]] if len(code) else np.zeros(0, bool)
                start, of = np.flatnonzero(new), np.cumsum(new) - 1
                one = n * (code >> np.uint64(7 - b) & np.uint64(1))
                ones, total = (np.add.reduceat(x, start) if len(start) else x for x in (one, n))
                if to is None:
                    at, below = np.arange(len(code)), None
                    p, block = (ones + 0.5) / (total + 1.0), kt_block_log((total - ones).astype(np.int64), ones.astype(np.int64))
                    deep = p[of]
                else:
                    at = to[at]
                    below = np.bincount(of[to[first]], block, len(start))
                    p, share, block = mixed(total - ones, ones, below)
                    own = of[at]
                    deep = np.where(seen, share[own] * p[own] + (1 - share[own]) * deep, p[own])
                seen, first = (total > 0)[of[at]], start
            decision = np.uint64(1 << b) | top[first] & np.uint64((1 << b) - 1)
            found.append((code[first] >> np.uint64(8) << np.uint64(8) | decision, total - ones, ones, block))
            self.node.append(of[at])
            self.deep.append(deep)
        keys, zeros, ones, block = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(keys)
        self.keys, self.zeros, self.ones, self.block = keys[order], zeros[order], ones[order], block[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.cumsum([0, *(len(f[0]) for f in found)])
        self.node = [place[before[b] + x] for b, x in enumerate(self.node)]


#: pair: the two bytes nearest to the predicted one, or -1 for the nodes above; bucket: -1 for sums that go up.
_NODES = "bucket int, kind string, pair int, byte int, keys binary, sums binary"


def _nodes(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["bucket", "kind", "pair", "byte", "keys", "sums"])


def _sums(data: bytes) -> np.ndarray:
    return np.frombuffer(data).reshape(3, -1)


def _parts(depth: int):
    """Bucket to a row for each node of depth 2 above it: zeros, ones and block logs of the bucket's nodes of depth PREFIX."""

    def run(key, table):
        if key[1].as_py() != "g":
            return _nodes([])
        tree = Tree(*_all_windows(table), depth)
        pair = tree.keys >> np.uint64(8 * (PREFIX - 1))
        cuts = np.r_[np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]), len(pair)] if len(pair) else [0]
        low = (tree.keys & np.uint64((1 << 8 * (PREFIX - 1)) - 1)).astype("<u4")
        return _nodes([(key[0].as_py(), "g", int(pair[a]), int(pair[a]) >> 8, low[a:b].tobytes(), np.stack([tree.zeros[a:b], tree.ones[a:b], tree.block[a:b]]).tobytes()) for a, b in zip(cuts, cuts[1:])])

    return run


def _under_two_bytes(table: pa.Table) -> pa.Table:
    """All nodes of depth PREFIX below one of depth 2: its sums go up, and to each bucket goes, for each of its nodes, (x, y)
    such that x + y * p is the prediction at depth 2 if p is the one at depth PREFIX. x is -1 where depth 2 has not met the decision."""
    rows = table.to_pylist()
    keys = [np.frombuffer(r["keys"], "<u4") for r in rows]
    zeros, ones, block = np.concatenate([_sums(r["sums"]) for r in rows], axis=1)
    key, at = np.concatenate(keys), np.arange(sum(map(len, keys)))
    chain = [(None, None, zeros + ones > 0, at)]
    for _ in range(PREFIX - 2):
        key, to = np.unique(key >> 16 << 8 | key & 255, return_inverse=True)
        zeros, ones, below = (np.bincount(to, v, len(key)) for v in (zeros, ones, block))
        p, share, block = mixed(zeros, ones, below)
        at = to[at]
        chain.append((p, share, zeros + ones > 0, at))
    seen = chain[0][2]
    x, y = np.zeros(len(seen)), np.ones(len(seen))
    for p, share, met, at in chain[1:]:
        x, y = np.where(seen, share[at] * p[at] + (1 - share[at]) * x, p[at]), np.where(seen, (1 - share[at]) * y, 0.0)
        seen = met[at]
    x[~seen] = -1
    pair, byte = rows[0]["pair"], rows[0]["byte"]
    out = [(-1, "g", pair, byte, key.astype(np.uint8).tobytes(), np.stack([zeros, ones, block]).tobytes())]
    cuts = np.cumsum([0, *map(len, keys)])
    return _nodes(out + [(r["bucket"], "g", pair, byte, b"", np.stack([x[a:b], y[a:b]]).tobytes()) for r, a, b in zip(rows, cuts, cuts[1:])])


def _under_one_byte(table: pa.Table) -> pa.Table:
    """At most 256 nodes of depth 2 to the sums of the one of depth 1 above: zeros, ones and children's block logs of 255 decisions."""
    total = np.zeros((3, 255))
    for r in table.to_pylist():
        total[:, np.frombuffer(r["keys"], np.uint8) - 1] += _sums(r["sums"])
    return _nodes([(-1, "g", -1, table.column("byte")[0].as_py(), b"", total.tobytes())])


def _root(buckets: int):
    """At most 256 nodes of depth 1 to the mixture of depths 0 and 1, sent to every bucket."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("byte")
        sums = np.stack([_sums(x) for x in table.column("sums").to_pylist()])
        data = top_mixture(sums).tobytes()
        present = np.array(table.column("byte").to_pylist(), np.uint8).tobytes()
        return _nodes([(b, "g", -1, -1, present, data) for b in range(buckets)])

    return run


def top_mixture(sums: np.ndarray) -> np.ndarray:
    """sums: nodes of depth 1, three, decisions. Returns for each node, and last for bytes without one, (x, y, z): the prediction is x + y * p if p
    is that of depth 2, and z where depth 2 has not met the decision."""
    zeros, ones, below = sums[:, 0], sums[:, 1], sums[:, 2]
    p, share, block = mixed(zeros, ones, below)
    root, top, _ = mixed(zeros.sum(axis=0), ones.sum(axis=0), block.sum(axis=0))
    under = (1 - top) * (1 - share)
    out = np.zeros((len(sums) + 1, 3, sums.shape[2]))
    out[:-1] = np.stack([top * root + (1 - top) * share * p, under, np.where(zeros + ones > 0, top * root + (1 - top) * p, root)], axis=1)
    out[-1, 2] = root
    return out


def _answers(depth: int):
    """Bucket to what each chunk asked for: log10 probabilities of windows, or counts, sums and kinds of words."""

    def windows(table: pa.Table, above: pa.Table):
        code, n = _all_windows(table)
        tree = Tree(code, n, depth)
        rows = above.sort_by("pair").to_pylist()
        mix = np.full((1, 3, 255), 0.5)
        slot = np.zeros(256, np.int64)
        if rows and rows[0]["pair"] < 0:
            mix = np.frombuffer(rows[0]["sums"]).reshape(-1, 3, 255)
            slot[:] = len(mix) - 1
            slot[np.frombuffer(rows[0]["keys"], np.uint8)] = np.arange(len(mix) - 1)
        x, y = (np.concatenate(v) if v else np.zeros(0) for v in ([np.frombuffer(r["sums"]).reshape(2, -1)[i] for r in rows if r["pair"] >= 0] for i in (0, 1)))
        near, byte = slot[(code >> np.uint64(8 * depth)).astype(np.int64)], (code & np.uint64(255)).astype(np.int64)
        logs = np.zeros(len(code))
        for b in range(8):
            at, decision = tree.node[b], (256 | byte) >> (8 - b)
            base = x[at]
            upper = mix[near, :, decision - 1]
            p = np.where(base < 0, upper[:, 2], upper[:, 0] + upper[:, 1] * (base + y[at] * tree.deep[b]))
            logs += np.log(np.where(byte >> (7 - b) & 1, p, 1 - p))
        logs = (logs / math.log(10)).astype(np.float32)
        return [logs[np.searchsorted(code, _unpacked(k.as_py()))].tobytes() for k in table.column("key")], 0, 0

    def words(table: pa.Table, _):
        keys = [_unpacked(x) for x in table.column("key").to_pylist()]
        n = np.concatenate([_unpacked_counts(x) for x in table.column("n").to_pylist()]).astype(np.float64)
        u, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, n, len(u)).astype("<i8")
        cuts = np.cumsum([0, *map(len, keys)])
        return [total[at[a:b]].tobytes() for a, b in zip(cuts, cuts[1:])], int(total.sum()), int((total > 0).sum())

    def answer(key, table, above):
        data, tokens, known = (windows if key[1].as_py() == "g" else words)(table, above)
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "kind": table.column("kind"), "data": pa.array(data, pa.binary()), "tokens": pa.array([tokens] * len(data), pa.int64()), "known": pa.array([known] * len(data), pa.int64())})

    return answer


def _scores(depth: int, buckets: int):
    """A chunk's texts and the answers to it, which are in the order in which it has asked, to scores."""

    def rate(key, texts, answers):
        count = texts.num_rows
        tokens, known, logs, n, held = 0, 0, [], [], []
        for r in answers.sort_by("bucket").to_pylist():
            if r["kind"] == "g":
                logs.append(np.frombuffer(r["data"], np.float32))
            else:
                n.append(np.frombuffer(r["data"], "<i8"))
                tokens, known = tokens + r["tokens"], known + r["known"]
        score, size, length, hashes = np.zeros(count), np.zeros(count, np.int64), np.ones(count, np.int64), [np.zeros(0, np.uint64)]
        for begin, end in _slices(texts.column("text")):
            code, own = window_codes([b" ".join(_words(t.as_py())) for t in texts.column("text")[begin:end]], depth)
            held = _gathered(held, code, np.zeros(len(code), bool))
        code = _merged(held)[0][0]
        find = Lookup(code[_by_bucket(code, depth, buckets)[1]], np.concatenate(logs)) if count else None
        for begin, end in _slices(texts.column("text")):
            words = [_words(t.as_py()) for t in texts.column("text")[begin:end]]
            size[begin:end] = [len(w) + 1 for w in words]
            hashes += [_hashes(w) for w in words]
            code, own = window_codes([b" ".join(w) for w in words], depth)
            score[begin:end] = np.bincount(own, find(code), end - begin)
            length[begin:end] = np.bincount(own, minlength=end - begin)
        row = np.repeat(np.arange(count), size)
        _, at = np.unique(np.concatenate(hashes), return_inverse=True)
        n = np.concatenate(n) if n else np.zeros(0, np.int64)
        base = np.log10((n + 1.0) / (tokens + known + 1.0))
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": size, "n_known": np.bincount(row, (n > 0)[at], count).astype(np.int64), "train_tokens": np.full(count, tokens), "base_score": np.bincount(row, base[at], count).astype(float), "score": score, "bits_per_byte": -score * math.log2(10) / length})

    return rate


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2, depth: int = DEPTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scores of every row of docs, learned from the rows outside the held-out fold. depth: PREFIX to 7."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (fold(id_col, folds) == held_fold).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(chunks)).cast("int")).repartition(chunks, "chunk")
    sent = dealt.groupBy("chunk").applyInArrow(_reader(depth, chunks), "chunk int, bucket int, kind string, key binary, n binary")
    # both read one exchange of what was sent, a bucket or two in a task: joined partitions would fill the executors' memory
    sent = sent.repartition(2 * chunks, "bucket", "kind")
    parts = sent.groupBy("bucket", "kind").applyInArrow(_parts(depth), _NODES)
    two = parts.groupBy("pair").applyInArrow(_under_two_bytes, _NODES)
    one = two.where("bucket < 0").groupBy("byte").applyInArrow(_under_one_byte, _NODES)
    root = one.groupBy("pair").applyInArrow(_root(chunks), _NODES)
    above = two.where("bucket >= 0").unionByName(root)
    answers = sent.groupBy("bucket", "kind").cogroup(above.groupBy("bucket", "kind")).applyInArrow(_answers(depth), "chunk int, bucket int, kind string, data binary, tokens long, known long")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scores(depth, chunks), schema)
