"""SimHash near-dedup over a Gray-order hierarchical index.

A fingerprint is the bitwise majority of hashes of a text's word shingles. Fingerprints meet in blocks, those that agree in some bits. Within
a block, they lie in the order of their Gray rank; runs of them form leaves and runs of nodes form upper nodes. A node holds the bits
that all below it share (a mask and a pattern). Two nodes are compared by the shared bits alone, adding the differences in newly
shared bits to those of their parents, and the pair is dropped as soon as the sum is over the distance. Only fingerprints of surviving leaf pairs are
compared. A block gives a spanning forest of its links, nearest pairs first, never all its pairs. Blocks of more than BLOCK_MOST rows
are dealt, by pairs of parts, to several tasks.

near_groups() takes 64 bits and links what differs in at most `distance` of them: blocks are choices of whole bands, so that no link is lost. keep_one()
takes WIDE_BITS, in which the share of differing bits tells the similarity of two sets of shingles (the angle between them over pi). Blocks are bands
of some bits, so many that two texts of the least similarity share one with probability RECALL. Links that leave doubt are
checked against the shingles themselves; those within SURE_BITS stand for a similarity of about 0.94 and more. Components that refuted links hold together
are then compared as a whole, row by row within the distance, so that a refuted link costs no other one; of each such cluster, rows of the largest component are compared with the others alone.

Defined cases: null text counts as empty; a text without words has no shingles and fingerprint zero; fewer words than a
shingle give one shingle; repeated rows are all returned; a null doc_id never is a component's id unless all are null; extra columns are
ignored, and kept by keep_one() whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.common import BROADCAST_ROWS, free_names, quoted, stored, within, without
from flowsift.llm.components import connected_components
from flowsift.llm.exact_dedup import COUNTERS, text_digest

SHINGLE, DISTANCE, SEED = 3, 3, 42
LEAF, FANOUT = 16, 16
#: Fingerprints that a block holds on average before more bands are taken, and that one task takes of a block.
BLOCK_ROWS, BLOCK_MOST = 4096, 16_384
PAIRS_AT_ONCE = 2_000_000
#: keep_one(): words of a shingle, least similarity (Jaccard), bits, differing bits of a sure link, share of least similar pairs that meet.
COPY_SHINGLE, SIMILARITY, WIDE_BITS, SURE_BITS, RECALL = 5, 0.8, 512, 40, 0.95
WORDS = [f"f{i}" for i in range(WIDE_BITS // 64)]


def shingle_hashes(text: str | None, shingle: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist())], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Words of the bits that are set in over half of the hashes (rows of words)."""
    ones = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 255):  # sums of 255 bits fit a byte
        ones += np.unpackbits(hashes[at : at + 255].astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).view(">u8").astype(np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit fingerprint."""
    return int(majority(shingle_hashes(text, shingle, seed)[:, None]).view(np.int64)[0])


def wide_fingerprint(text: str | None, shingle: int = COPY_SHINGLE, seed: int = SEED) -> np.ndarray:
    """WIDE_BITS bits over distinct shingles, whose hashes are stretched by a mixing function."""
    x = np.unique(shingle_hashes(text, shingle, seed))[:, None] + np.arange(len(WORDS), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return majority(x ^ x >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle, seed) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = COPY_SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, digest (of the text) and the words of the wide fingerprint of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([wide_fingerprint(t.as_py(), shingle, seed) for t in b.column(2)], np.uint64).reshape(-1, len(WORDS)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c) for c in fps.T)], ["doc_id", "digest", *WORDS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(text_col).alias("digest"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(["doc_id long, digest binary", *(f"{w} long" for w in WORDS)]))


def block_masks(rows: int, distance: int = DISTANCE, block_rows: int = BLOCK_ROWS) -> list[int]:
    """Bit masks such that any two fingerprints within distance agree under one; more bands as rows grow."""
    for chosen in range(1, 4):
        bands = distance + chosen
        edges = [round(i * 64 / bands) for i in range(bands + 1)]
        if rows <= block_rows << (64 * chosen // bands) or chosen == 3:
            parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
            return [sum(c) for c in combinations(parts, chosen)]
    raise AssertionError


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def gray_rank(fp):
    """The place of a fingerprint in Gray order: the number whose Gray code it is."""
    for by in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, by))
    return fp


def _products(a0, na, b0, nb):
    """All index pairs of ragged ranges a0..a0+na and b0..b0+nb, with the number of their range pair."""
    size = na * nb
    which = np.repeat(np.arange(len(size)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return which, a0[which] + at // nb[which], b0[which] + at % nb[which]


class Links:
    """Components of the rows of some blocks (label: the first row of each), and the pairs that joined them."""

    def __init__(self, rows: int) -> None:
        self.label = np.arange(rows)
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        """Joins along links (i, j) of distance d: again and again, each component along its nearest."""
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, d, a, b = (x[apart] for x in (i, j, d, a, b))
            end, link = np.concatenate([a, b]), np.tile(np.arange(len(i)), 2)
            order = np.lexsort((link, d[link], end))
            nearest = np.unique(link[order][np.r_[True, end[order][1:] != end[order][:-1]]])
            self.pairs.append((i[nearest], j[nearest], d[nearest]))
            np.minimum.at(self.label, np.maximum(a, b)[nearest], np.minimum(a, b)[nearest])
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up


def block_links(block: np.ndarray, fp: np.ndarray, distances: list[int]) -> Links:
    """The links inside blocks, those within the first distance before those within the next. block is sorted; fp (rows of words) is in Gray order in each."""
    n = len(fp)
    new = np.r_[True, block[1:] != block[:-1]]
    first = np.flatnonzero(new)
    inside = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    start = np.flatnonzero(inside % LEAF == 0)
    levels = []
    ands, ors, of = np.bitwise_and.reduceat(fp, start), np.bitwise_or.reduceat(fp, start), np.cumsum(new)[start] - 1
    levels.append((start, np.diff(np.r_[start, n]), ~(ands ^ ors), ands))
    while len(of) > len(first):
        k = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        inside = np.arange(len(of)) - np.repeat(k, np.diff(np.r_[k, len(of)]))
        start = np.flatnonzero(inside % FANOUT == 0)
        ands, ors = np.bitwise_and.reduceat(ands, start), np.bitwise_or.reduceat(ors, start)
        levels.append((start, np.diff(np.r_[start, len(of)]), ~(ands ^ ors), ands))
        of = of[start]
    links, roots = Links(n), np.arange(len(levels[-1][0]))
    for distance in distances:
        _descend(levels, len(levels) - 1, roots, roots, np.zeros(len(roots), np.int64), np.zeros((len(roots), fp.shape[1]), np.uint64), fp, distance, links)
    return links


def _descend(levels, depth, a, b, differing, compared, fp, distance, links: Links) -> None:
    """Goes down from the node pairs (a, b), whose shared bits `compared` differ in `differing` places."""
    start, size, mask, pattern = levels[depth]
    both = mask[a] & mask[b]
    differing = differing + np.bitwise_count((pattern[a] ^ pattern[b]) & both & ~compared).sum(axis=1)
    near = differing <= distance
    a, b, differing, both = a[near], b[near], differing[near], both[near]
    order = np.argsort(differing + 2 * (a != b), kind="stable")
    a, b, differing, both = a[order], b[order], differing[order], both[order]
    work, most = np.cumsum(size[a] * size[b]), PAIRS_AT_ONCE // fp.shape[1]
    cuts = np.searchsorted(work, np.arange(most, work[-1] + most, most), "right") if len(work) else []
    at = 0
    for to in cuts:
        to = min(max(to, at + 1), len(a))
        if at >= len(a):
            break
        x, y, d, c = a[at:to], b[at:to], differing[at:to], both[at:to]
        at = to
        if depth == 0:
            low, high = np.minimum.reduceat(links.label, start), np.maximum.reduceat(links.label, start)
            open_ = ~((low[x] == high[x]) & (low[y] == high[y]) & (low[x] == low[y]))
            x, y = x[open_], y[open_]
        which, i, j = _products(start[x], size[x], start[y], size[y])
        ordered = (x[which] != y[which]) | (i < j if depth == 0 else i <= j)
        which, i, j = which[ordered], i[ordered], j[ordered]
        if depth == 0:
            apart = np.bitwise_count(fp[i] ^ fp[j]).sum(axis=1)
            hit = apart <= distance
            links.add(i[hit], j[hit], apart[hit])
        else:
            _descend(levels, depth - 1, i, j, d[which], c[which], fp, distance, links)


def _forest(words: int, distances: list[int]):
    """Rows (block, node, words), blocks together and in Gray order, to the links of their forests."""

    def found(block, node, fp):
        links = block_links(block, fp, distances)
        i, j, d = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*links.pairs) if links.pairs else ([], [], [])))
        return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j]), pa.array(d.astype(np.int32))], ["hi", "lo", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 2 + words), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            held = np.concatenate([held, np.stack([c.to_numpy() for c in b.columns], axis=1)])
            change = np.flatnonzero(held[1:, 0] != held[:-1, 0])
            if len(held) > 200_000 // words and len(change):
                cut = change[-1] + 1
                yield found(held[:cut, 0], held[:cut, 1], held[:cut, 2:].view(np.uint64))
                held = held[cut:]
        if len(held):
            yield found(held[:, 0], held[:, 1], np.ascontiguousarray(held[:, 2:]).view(np.uint64))

    return run


def forest(nodes: DataFrame, words: list[str], keys: list, distances: list[int], most: int = BLOCK_MOST) -> DataFrame:
    """hi, lo, d: a spanning forest, in each block, of the links between the nodes of different fingerprints.

    nodes: node (long) and the words of its fingerprint. keys: a column for each table; nodes of equal keys are a block.
    """
    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), k.alias("k")) for t, k in enumerate(keys)])).alias("b")
    rows = nodes.select("node", *words, table).select(F.xxhash64("b.t", "b.k").alias("block"), "node", *words)
    share = 16
    seen = rows.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(share)) == 0).groupBy("block").agg(F.count("*").alias("n"))
    large = stored(seen.where(F.col("n") * share > most).select(F.col("block").alias("large"), F.ceil(F.col("n") * share * 2 / most).alias("parts")), "large_blocks")
    size = large.count()
    if size:
        large = F.broadcast(large) if size <= BROADCAST_ROWS else large
        own = F.pmod(F.xxhash64("node", F.lit(2)), F.coalesce("parts", F.lit(1)))
        rows = rows.join(large, rows["block"] == large["large"], "left").select("block", "node", *words, own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("other"))
        rows = rows.select(F.xxhash64("block", F.least("own", "other"), F.greatest("own", "other")).alias("block"), "node", *words)
    rows = rows.repartition("block").sortWithinPartitions("block", gray_rank(F.col(words[0])), "node")
    return rows.mapInArrow(_forest(len(words), distances), "hi long, lo long, d int")


def linked(fps: DataFrame, distance: int = DISTANCE, block_rows: int = BLOCK_ROWS, most: int = BLOCK_MOST) -> DataFrame:
    """hi, lo: links that connect the distinct fingerprints (column fp) as all links within distance do."""
    keys = [F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in block_masks(fps.count(), distance, block_rows)]
    return forest(fps.select(F.col("fp").alias("node"), "fp"), ["fp"], keys, [distance], most).select("hi", "lo")


def with_component(rows: DataFrame, named: DataFrame, on: list[str]) -> DataFrame:
    """rows with the columns of named, which has one row for each value of `on` and n, how many rows have it. Values that more than one row in 1,024 has (fewer than 1,024
    values) meet their rows by a broadcast, so no task gets all rows of such a value; the others are shuffled."""
    least = (named.agg(F.sum("n")).first()[0] or 0) // (COUNTERS + 1)
    hot = F.broadcast(named.where(F.col("n") > least).drop("n"))
    cold = named.where(F.col("n") <= least).drop("n")
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold, on))


def _grouped(fps: DataFrame, distance: int, block_rows: int) -> DataFrame:
    """The rows of fps with root (one fingerprint for each component) and component_id."""
    known = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "distinct")
    parts = connected_components(linked(known.select("fp"), distance, block_rows))
    rooted = known.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root"))
    rooted = stored(rooted, "rooted")
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(rooted.join(first, "root").select("fp", "root", "component_id", "n"), "named")
    return with_component(fps, named, ["fp"])


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (smallest doc_id reachable over links)."""
    fps = stored(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    return _grouped(fps, distance, block_rows).select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def differing_share(similarity: float) -> float:
    """Expected share of differing bits of two sets, as large as each other, of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def band_keys(rows: int, similarity: float = SIMILARITY, recall: float = RECALL) -> list:
    """A key for each table: width bits of the fingerprint, more for more rows; so many tables that a pair meets with probability recall."""
    width = min(32, max(8, math.ceil(math.log2(max(2, rows))) - 6))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differing_share(similarity)) ** width))
    words = [F.col(w) for w in WORDS]
    views = [words]
    turned = [F.shiftleft(w, 32).bitwiseOR(F.shiftrightunsigned(w, 32)) for w in words]
    for right in (words, turned):  # bands of other choices of bits
        for mask in (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x00FF00FF00FF00FF):
            other = F.lit(_signed(mask ^ (1 << 64) - 1))
            views += [[a.bitwiseAND(F.lit(mask)).bitwiseOR(b.bitwiseAND(other)) for a, b in zip(words, right[r:] + right[:r])] for r in range(1, len(words))]
    keys = [F.shiftrightunsigned(w, at * width).bitwiseAND(F.lit((1 << width) - 1)) for view in views for w in view for at in range(64 // width)]
    if tables > len(keys):
        raise ValueError(f"{tables} tables are needed, {len(keys)} can be made")
    return keys[:tables]


def _sets(nodes: DataFrame, docs: DataFrame, text_col: str, shingle: int, seed: int) -> DataFrame:
    """nodes (with sample, a text's digest) with set: the sorted hashes of the distinct shingles of that text."""
    nodes = stored(nodes, "ends")
    texts = docs.select(text_digest(text_col).alias("digest"), F.col(text_col).alias("text"))
    wanted = nodes.select(F.col("sample").alias("digest")).distinct()
    texts = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, "digest", "left_semi").dropDuplicates(["digest"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingle_hashes(t.as_py(), shingle, seed)).tobytes() for t in b.column(1)], pa.binary())], ["sample", "set"])

    return stored(nodes.join(texts.mapInArrow(sets, "sample binary, set binary"), "sample").drop("sample"), "sets")


def _similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text_col: str, shingle: int, similarity: float, seed: int) -> DataFrame:
    """pairs (x, y, hi, lo) with alike: whether the texts of hi and lo share at least `similarity` of their distinct shingles. nodes: node, sample."""
    ends = pairs.select(F.explode(F.array("hi", "lo")).alias("node")).distinct().join(nodes.select("node", "sample"), "node")
    known = _sets(ends, docs, text_col, shingle, seed)
    both = pairs.join(known.select(F.col("node").alias("hi"), F.col("set").alias("a")), "hi").join(known.select(F.col("node").alias("lo"), F.col("set").alias("b")), "lo")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for a, b in zip(batch.column(4), batch.column(5)):
                a, b = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                alike.append(shared >= similarity * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(alike, pa.bool_())], ["x", "y", "hi", "lo", "alike"])

    return both.select("x", "y", "hi", "lo", "a", "b").mapInArrow(check, "x long, y long, hi long, lo long, alike boolean")


def alike_rows(fp: np.ndarray, sets: list[np.ndarray], label: np.ndarray, others: np.ndarray, other_sets: list[np.ndarray], other_label: np.ndarray, farthest: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of labels of rows and others that have alike sets, as many as join what all such pairs join. Compared are rows of different labels within a distance, the nearest
    first, until their labels are joined or none is left."""
    pairs, up = [], {}

    def root(x: int) -> int:
        while (above := up.get(x, x)) != x:
            up[x] = x = up.get(above, above)
        return x

    sizes = np.array([len(x) for x in other_sets], np.int64)
    for k, own in enumerate(sets):
        apart = np.bitwise_count(fp[k] ^ others).sum(axis=1)
        left = np.flatnonzero((apart <= farthest) & (other_label != label[k]) & (sizes >= similarity * len(own)) & (similarity * sizes <= len(own)) & (sizes > 0))
        left, many = left[np.argsort(apart[left], kind="stable")], 32
        while len(left):
            at, left = left[:many], left[many:]
            values = np.concatenate([other_sets[j] for j in at])
            place = np.minimum(np.searchsorted(own, values), len(own) - 1)
            shared = np.add.reduceat(own[place] == values, np.cumsum(sizes[at]) - sizes[at], dtype=np.int64)
            for j in at[shared >= similarity * (len(own) + sizes[at] - shared)]:
                a, b = root(int(label[k])), root(int(other_label[j]))
                if a != b:
                    up[max(a, b)] = min(a, b)
                    pairs.append((int(label[k]), int(other_label[j])))
            here, many = root(int(label[k])), 4 * many
            known: dict[int, bool] = {}
            left = left[np.array([known[x] if x in known else known.setdefault(x, root(x) != here) for x in other_label[left].tolist()], bool)]
    return pairs


def _joins(members: DataFrame, farthest: int, similarity: float, rows: int = BLOCK_ROWS // 2, size: int = 16 << 20) -> DataFrame:
    """hi, lo: pairs of components of a cluster to be joined. members: node, cluster, component, the words of the fingerprint, set.

    Rows of the largest component of a cluster are compared with the others only. Both sides are dealt to parts of so many rows or bytes of sets; each pair of parts is a group."""
    weight = lambda: F.ceil(F.greatest(F.count("*") / rows, F.sum(F.length("set")) / size))
    large = members.groupBy("cluster", "component").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "component")).alias("m")).select("cluster", F.col("m.component").alias("largest"))
    marked = stored(members.join(large, "cluster").withColumn("small", F.col("component") != F.col("largest")).drop("largest"), "members")
    parts = marked.groupBy("cluster").agg(weight().alias("all_parts"), F.ceil(F.greatest(F.count_if("small") / rows, F.sum(F.when(F.col("small"), F.length("set")).otherwise(0)) / size)).alias("small_parts"))
    parts = stored(parts, "parts")
    marked = marked.join(parts, "cluster")
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    kept = ["cluster", "component", *WORDS, "set"]
    own = lambda n: F.pmod(F.xxhash64("node"), n)
    left = marked.where("small").select(*kept, own(F.col("small_parts")).alias("l"), to(F.col("all_parts")).alias("r"))
    right = marked.select(*[F.col(c).alias(c) for c in kept], own(F.col("all_parts")).alias("r"), to(F.col("small_parts")).alias("l"))

    def check(left, right):
        sides = []
        for t in (left, right):
            fp = np.stack([t.column(w).to_numpy() for w in WORDS], axis=1).view(np.uint64)
            sides.append((fp, [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()], t.column("component").to_numpy()))
        pairs = alike_rows(*sides[0], *sides[1], farthest, similarity) if left.num_rows and right.num_rows else []
        return pa.table([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["hi", "lo"])

    key = ["cluster", "l", "r"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(check, "hi long, lo long")


def _joined(component: DataFrame, merged: DataFrame) -> DataFrame:
    """component (node, root) after the roots in merged (node, root) have become others, and with roots that it did not have."""
    moves = merged.select(F.col("node").alias("old"), F.col("root").alias("new"))
    known = component.join(moves, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    return known.unionByName(moves.join(component, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = COPY_SHINGLE, similarity: float = SIMILARITY, seed: int = SEED, most: int = BLOCK_MOST) -> DataFrame:
    """doc_id, digest (of the text), root, component_id of every row: components of texts whose distinct shingles have at least this Jaccard similarity."""
    fps = stored(wide_fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    nodes = stored(fps.groupBy(*WORDS).agg(F.min("doc_id").alias("first_id"), F.min("digest").alias("sample"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    share = differing_share(similarity)
    farthest = math.ceil(WIDE_BITS * share + 2 * math.sqrt(WIDE_BITS * share * (1 - share)))
    steps = sorted({round(x) for x in np.linspace(min(SURE_BITS, farthest), farthest, 5)})
    keys = band_keys(nodes.count(), similarity)
    found = forest(nodes.select("node", *WORDS), WORDS, keys, steps, most)
    found = stored(found.groupBy(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).agg(F.min("d").alias("d")), "links")
    component = stored(connected_components(found.where(F.col("d") <= SURE_BITS).select("hi", "lo")), "sure")
    at = lambda end: component.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    rest = found.where(F.col("d") > SURE_BITS).join(at("hi"), "hi", "left").join(at("lo"), "lo", "left")
    rest = rest.select("hi", "lo", "d", F.coalesce("hi_root", "hi").alias("a"), F.coalesce("lo_root", "lo").alias("b")).where("a != b")
    # of the links between two components the nearest is checked
    rest = rest.groupBy(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).agg(F.min_by(F.struct("hi", "lo"), F.struct("d", "hi", "lo")).alias("l"))
    rest = stored(rest.select("x", "y", "l.hi", "l.lo"), "doubtful")
    checked = stored(_similar(rest, nodes, docs, text_col, shingle, similarity, seed), "checked")
    component = stored(_joined(component, connected_components(checked.where("alike").select(F.col("x").alias("hi"), F.col("y").alias("lo")))), "components")
    # where a link is refuted, others between the same components may hold, or such by way of a third: these components are compared as a whole
    refuted = checked.where("NOT alike").select("hi", "lo").join(at("hi"), "hi", "left").join(at("lo"), "lo", "left").select(F.coalesce("hi_root", "hi").alias("hi"), F.coalesce("lo_root", "lo").alias("lo"))
    cluster = connected_components(refuted.where("hi != lo")).select(F.col("node").alias("component"), F.col("root").alias("cluster"))
    members = nodes.join(component, "node", "left").select("node", "sample", *WORDS, F.coalesce("root", "node").alias("component")).join(cluster, "component")
    joins = _joins(_sets(members, docs, text_col, shingle, seed), farthest, similarity)
    component = stored(_joined(component, connected_components(joins)), "components")
    rooted = nodes.join(component, "node", "left").withColumn("top", F.coalesce("root", "node"))
    rooted = stored(rooted.select(*WORDS, "first_id", "n", F.col("top").alias("root")), "rooted")
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(rooted.drop("first_id").join(first, "root"), "named")
    return with_component(fps, named, WORDS).select("doc_id", "digest", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = COPY_SHINGLE, similarity: float = SIMILARITY, seed: int = SEED, most: int = BLOCK_MOST) -> DataFrame:
    """docs with one row of each component of near_copies(), all columns as they were: one of the smallest doc_id (null only if all are).

    Rows are told apart by (doc_id, text), so other rows with the same or no doc_id are judged by their own components.
    Where several rows of a component carry the doc_id that stays, the text of the smallest digest does.
    """
    on = free_names(docs.columns, "own_id", "own_digest")
    groups = stored(near_copies(docs, id_col, text_col, shingle, similarity, seed, most), "components")
    mine = F.col("doc_id").eqNullSafe(F.col("component_id"))
    several = groups.where(mine).groupBy("root", "component_id", "digest").agg(F.count("*").alias("n"))
    several = several.groupBy("root", "component_id").agg(F.sum("n").alias("rows"), F.min(F.struct("digest", "n")).alias("stays")).where("rows > 1")
    several = stored(several.select(F.col("root").alias("own_root"), F.col("component_id").alias(on[0]), F.col("stays.digest").alias(on[1]), F.col("stays.n").alias("n")), "several")
    keys = [F.col("doc_id").alias(on[0]), F.col("digest").alias(on[1])]
    lost = groups.where(~mine).select(*keys)
    lost = lost.unionByName(groups.where(mine).join(several.select("own_root", F.col(on[1]).alias("stays")), F.col("root") == F.col("own_root")).where("digest != stays").select(*keys))
    again = several.where("n > 1").select(*on)
    left = without(docs.withColumns({on[0]: F.col(id_col).cast("long"), on[1]: text_digest(text_col)}), lost, on)
    if not again.isEmpty():
        left = without(left, again, on).unionByName(within(left, again, on).dropDuplicates(on))
    return left.select(*quoted(docs.columns))
