"""Main text of web pages by wrapper induction.

A page becomes a tree of its block elements; inline elements belong to the text of their block. Sibling items of one kind (paragraphs, list items, rows) fold
into one node, so that pages of different lengths have trees of the same shape. The most frequent tree of a host is its wrapper. Every other tree
of the host is aligned with it by simple tree matching: roots of one kind match, and of their children the most that match in order. All pages of a host
count what stands in each slot of the wrapper: a text that TEMPLATE_SHARE of them repeat there is template, the other slots vary and hold content. The
main region is the deepest node that holds REGION_SHARE of the varying text that is not links, but where pages mark theirs (article, main), that mark holds.
A page's text is what lies in the main region, less template and less what menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments are marked with (elements, roles, or names of class and id).

Pages are read twice. Between the scans only hashes of texts are shuffled, counted by host, slot and text; no task or driver sees a host whole.

Defined cases: null and empty pages have an empty text. A null address, or one without a host, belongs to the host of the empty name. Hosts of
less than LEAST_PAGES pages have no template, and a page all of whose text would be template keeps it (copies of one page are not template). A page
without a main region, or with nothing in it, gives all that is not marked as something else. White space is what str.split() takes for it. Elements that are not
closed end with their parent; a comment, script or style without an end reaches to the page's end. Elements below DEPTH count as parts of
that at DEPTH. Repeated rows are all returned; other columns are ignored.
"""

from __future__ import annotations

import html
import json
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.common import BROADCAST_ROWS, stored

LEAST_PAGES, TEMPLATE_SHARE, REGION_SHARE = 5, 0.9, 0.8
DEPTH = 100
BROADCAST_BYTES = 64 << 20
#: Pairs of subtrees whose match, and cells of child lists whose weights, an alignment holds before it drops them and makes them again.
HELD_PAIRS, HELD_CELLS = 500_000, 4_000_000
HELD_COUNTS = 200_000

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base col embed img input link meta param source track wbr".split())
#: Elements without text of their own: the first reach to the page's end if they are not closed, the others are passed over only if closed.
RAW, SKIPPED = frozenset("script style textarea title iframe noframes".split()), frozenset("noscript template svg object canvas audio video select button".split())
FLOW = frozenset("p li tr td th dt dd h2 h3 h4 h5 h6 ul ol dl pre blockquote figure table tbody thead figcaption #t".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes if it is open, and what it may close on the way to it (None: everything but a table).
CLOSES = {t: ({t, u}, {"address", "div", "p"}) for t, u in (("li", "li"), ("dt", "dd"), ("dd", "dt"))} | {t: (HEADINGS, set()) for t in HEADINGS} | {"tr": ({"tr"}, None), "td": ({"td", "th"}, None), "th": ({"td", "th"}, None)}
MAIN = {"main": 1, "article": 2, "articlebody": 2}
OTHER = frozenset("nav footer aside form menu dialog search fieldset head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of class and id names that mark what is not main text, and those that may hold its heading.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification disclaimer newsletter subscribe subscription signup popup modal overlay "
    "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs toc footer topbar toolbar share sharing social related recommended recommendations teaser pagination pager login search form comment comments commentlist disqus reply replies widget hidden skip".split()
)
HEADER_MARKS = frozenset("header masthead".split())
_WITHOUT = frozenset("has with no without not is".split())
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/\"'>]+)")


def host_column(url_col: str):
    return F.lower(F.regexp_extract(F.trim(F.coalesce(F.col(url_col), F.lit(""))), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _marked(tag: str, attributes: dict[str, str]) -> int:
    """2 if attributes say that an element is not main text, 1 if that it is a header, else 0. Ids of headings and paragraphs are anchors and don't count."""
    if "hidden" in attributes or attributes.get("role", "").lower() in ROLES or re.search(r"display\s*:\s*none", attributes.get("style", "")):
        return 2
    level = 0
    for name in f"{attributes.get('class', '')} {'' if tag == 'p' or tag in HEADINGS else attributes.get('id', '')}".split():
        parts = re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1-\2", name).lower())
        if parts and parts[0] not in _WITHOUT:
            level = max(level, 2 * (not MARKS.isdisjoint(parts)), not HEADER_MARKS.isdisjoint(parts))
    return level


class _Open(NamedTuple):
    """An open element: left out (2 wholly, 1 but for headings), main (2 in an article, 1 in another main part), inside a link, mute (an inline element that is left out)."""

    tag: str
    node: int
    out: int = 0
    main: int = 0
    link: bool = False
    mute: bool = False


class Page:
    """The tree of a page: of each node its kind, parent and children, and the blocks of text (node, text, characters in links, left out, main) in page order."""

    def __init__(self, source: str | None) -> None:
        self.kind, self.parent, self.children = ["#"], [-1], [[]]
        self.blocks: list[tuple[int, str, int, bool, int]] = []
        self._stack, self._pieces, self._linked = [_Open("", 0)], [], 0
        self._read(source or "")
        self._fold()

    def _flush(self) -> None:
        """Ends the block of text of the innermost open block element."""
        if self._pieces:
            top = self._stack[-1]
            text = " ".join(html.unescape("".join(self._pieces)).split())
            if text:
                self.blocks.append((self._node(top.node, "#t"), text, self._linked, top.out > 0, top.main))
            self._pieces = []
        self._linked = 0

    def _close(self, depth: int) -> None:
        if any(e.tag in BLOCKS for e in self._stack[depth:]):
            self._flush()
        del self._stack[depth:]

    def _read(self, source: str) -> None:
        stack, at = self._stack, 0
        while at < len(source):
            m = _TAG.search(source, at)
            text = source[at : m.start() if m else len(source)]
            if text and not stack[-1].mute:
                self._pieces.append(text)
                self._linked += len(text) * stack[-1].link
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag or tag in VOID:
                continue
            if m[1] or m[4]:
                self._end(tag)
            elif tag in RAW or tag in SKIPPED:
                closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(source, at)
                at = closing.end() if closing else len(source) if tag in RAW else at
            elif tag == "br":
                self._pieces.append(" ")
            elif tag == "hr":
                self._flush()
            else:
                self._start(tag, _attributes(m[3] or m[6] or ""))
        self._flush()

    def _end(self, tag: str) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k].tag == tag:
                return self._close(k)
            if tag not in BLOCKS and self._stack[k].tag in BLOCKS:
                return None
        return None

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        stack = self._stack
        if tag not in BLOCKS:
            top = stack[-1]
            stack.append(_Open(tag, top.node, top.out, top.main, top.link or tag == "a", top.mute or bool(attributes) and _marked(tag, attributes) > 0))
            return
        ends, through = CLOSES.get(tag, (set(), set()))
        for k in range(len(stack) - 1, 0, -1):
            other = stack[k].tag
            if other == "p" or other in ends:
                self._close(k)
                if other != "p":
                    break
            elif other == "table" or other in BLOCKS and through is not None and other not in through:
                break
        self._flush()
        top = stack[-1]
        main = max(MAIN.get(x, 0) for x in (tag, attributes.get("role", "").lower(), attributes.get("itemprop", "").lower()))
        level = _marked(tag, attributes) if attributes and tag not in ("html", "body", "main") else 0
        level = max(level, 2 * (tag in OTHER), tag == "header")
        level = 2 if level and not top.main else level
        out = 0 if tag in HEADINGS and top.out == 1 and level < 2 else max(top.out, level)
        node = top.node
        if len(stack) < DEPTH:
            name = (attributes.get("id") or attributes.get("class") or "").split()
            node = self._node(node, tag + (f".{re.sub('[^A-Za-z_-]', '', name[0])}" if name else ""), new=True)
        stack.append(_Open(tag, node, out, max(top.main, main) if not out else top.main, top.link, top.mute))

    def _node(self, parent: int, kind: str, new: bool = False) -> int:
        own = self.children[parent]
        if not new and own and self.kind[own[-1]] == kind:
            return own[-1]
        self.kind.append(kind)
        self.parent.append(parent)
        self.children.append([])
        own.append(len(self.kind) - 1)
        return own[-1]

    def _fold(self) -> None:
        """Makes siblings of one kind one node, where nothing but items of text flow or elements without children lies between them."""
        to = list(range(len(self.kind)))
        todo = [0]
        while todo:
            node = todo.pop()
            run: dict[str, int] = {}
            kept = []
            for c in self.children[node]:
                flows = self.kind[c].split(".")[0] in FLOW or all(self.kind[x] == "#t" for x in self.children[c])
                if not flows:
                    run = {}
                elif self.kind[c] in run:
                    first = run[self.kind[c]]
                    to[c] = first
                    for x in self.children[c]:
                        self.parent[x] = first
                    self.children[first] = self.children[first] + self.children[c]
                    continue
                else:
                    run[self.kind[c]] = c
                kept.append(c)
            self.children[node] = kept
            todo += kept
        self.blocks = [(to[n], *rest) for n, *rest in self.blocks]

    def shape(self) -> tuple[str, dict[int, int]]:
        """The tree as text, its nodes numbered from parent to children, and the number of each node."""
        number, rows = {}, []
        todo = [(0, -1)]
        while todo:
            node, above = todo.pop()
            number[node] = len(rows)
            rows.append((above, self.kind[node]))
            todo += [(c, number[node]) for c in reversed(self.children[node])]
        return json.dumps([[a for a, _ in rows], [k for _, k in rows]], separators=(",", ":")), number


def _lists(shape: str) -> tuple[list[str], list[list[int]]]:
    parents, kinds = json.loads(shape)
    children: list[list[int]] = [[] for _ in kinds]
    for node, above in enumerate(parents):
        if above >= 0:
            children[above].append(node)
    return kinds, children


def _subtrees(kinds: list[str], children: list[list[int]], known: dict[tuple, int]) -> tuple[list[int], list[int]]:
    """Of each node a number that equal subtrees share, and its number of nodes. known: numbers given so far."""
    own, size = [0] * len(kinds), [1] * len(kinds)
    for node in range(len(kinds) - 1, -1, -1):  # children come after parents
        own[node] = known.setdefault((kinds[node], *(own[c] for c in children[node])), len(known))
        size[node] += sum(size[c] for c in children[node])
    return own, size


def align(wrapper: str, shape: str) -> list[int]:
    """Of each node of a shape the node of the wrapper that it matches, or -1: simple tree matching.

    Equal subtrees are compared once, a row of a table at a time; of a table, some rows are kept and those between two of them made again on the way
    back, so that memory grows with the root of its cells.
    """
    kinds_a, below_a = _lists(wrapper)
    kinds_b, below_b = _lists(shape)
    if wrapper == shape:
        return list(range(len(kinds_b)))
    known: dict[tuple, int] = {}
    (own_a, size_a), (own_b, _) = _subtrees(kinds_a, below_a, known), _subtrees(kinds_b, below_b, known)
    most: dict[tuple[int, int], int] = {}

    def weigher(y: list[int]):
        """Of a node of the wrapper, what its matches with the nodes y weigh; 0 where kinds differ."""
        _, first, places = np.unique([own_b[j] for j in y], return_index=True, return_inverse=True)
        alike = [y[k] for k in first]
        rows: dict[int, np.ndarray] = {}

        def weights(i: int) -> np.ndarray:
            if own_a[i] not in rows:
                if len(rows) * len(y) > HELD_CELLS:
                    rows.clear()
                rows[own_a[i]] = np.array([matched(i, j) if kinds_a[i] == kinds_b[j] else 0 for j in alike], np.int64)[places]
            return rows[own_a[i]]

        return weights

    def below(above: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The row of a table behind that of the sibling before."""
        row = above.copy()
        np.maximum(row[1:], np.where(weight > 0, above[:-1] + weight, 0), out=row[1:])
        return np.maximum.accumulate(row)

    def matched(a: int, b: int) -> int:
        if own_a[a] == own_b[b]:
            return size_a[a]
        x, y = below_a[a], below_b[b]
        if not x or not y:
            return 1
        pair = own_a[a], own_b[b]
        if pair not in most:
            row, weights = np.zeros(len(y) + 1, np.int64), weigher(y)
            for i in x:
                row = below(row, weights(i))
            if len(most) > HELD_PAIRS:
                most.clear()
            most[pair] = 1 + int(row[-1])
        return most[pair]

    def pairs(x: list[int], y: list[int]) -> Iterator[tuple[int, int]]:
        """The children that match, from the last to the first."""
        if not x or not y:
            return
        weights, step = weigher(y), math.isqrt(len(x)) + 1
        row, kept = np.zeros(len(y) + 1, np.int64), []
        for place, i in enumerate(x):
            if place % step == 0:
                kept.append(row)
            row = below(row, weights(i))
        j = len(y)
        for part in range(len(kept) - 1, -1, -1):
            rows = [kept.pop()]
            for i in x[part * step : (part + 1) * step]:
                rows.append(below(rows[-1], weights(i)))
            k = len(rows) - 1
            while k and j:
                i = x[part * step + k - 1]
                weight = weights(i)[j - 1]
                if weight and rows[k][j] == rows[k - 1][j - 1] + weight:
                    k, j = k - 1, j - 1
                    yield i, y[j]
                elif rows[k][j] == rows[k - 1][j]:
                    k -= 1
                else:
                    j -= 1

    to = [-1] * len(kinds_b)
    todo = [(0, 0)]
    while todo:
        a, b = todo.pop()
        to[b] = a
        todo += pairs(below_a[a], below_b[b])
    return to


def _slots(page: Page, number: dict[int, int], to: list[int]) -> dict[int, int]:
    """The slot of each node with text: its match in the wrapper, or that of the nearest ancestor that has one."""
    slots = {}
    for node in {b[0] for b in page.blocks}:
        up = node
        while to[number[up]] < 0:
            up = page.parent[up]
        slots[node] = to[number[up]]
    return slots


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def counts(pages: DataFrame) -> DataFrame:
    """host, shape (a hash), node, text (a hash), n, chars, tree: on how many pages of a host and shape a text stands at a node; node -1 counts the pages and has the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def out():
            columns = zip(*((*k, *v) for k, v in held.items())) if held else [[]] * 7
            types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["host", "shape", "node", "text", "n", "chars", "tree"])

        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = Page(source.as_py())
                tree, number = page.shape()
                shape = _hash(tree)
                held.setdefault((host, shape, -1, 0), [0, 0, tree])[0] += 1
                for (node, text), plain in {(number[node], _hash(text)): max(0, len(text) - linked) for node, text, linked, left, _ in page.blocks if not left}.items():
                    seen = held.setdefault((host, shape, node, text), [0, 0, None])
                    seen[0] += 1
                    seen[1] += plain
                if len(held) > HELD_COUNTS:
                    yield out()
                    held.clear()
        yield out()

    return pages.select("host", "html").mapInArrow(run, "host string, shape long, node int, text long, n long, chars long, tree string")


def _region(wrapper: str, mass: dict[int, int], share: float) -> int:
    """The deepest node below which `share` of the mass lies; 0, the page, if there is none."""
    parents, kinds = json.loads(wrapper)
    total = [mass.get(k, 0) for k in range(len(kinds))]
    for node in range(len(kinds) - 1, 0, -1):
        total[parents[node]] += total[node]
    best = 0
    for node in range(1, len(kinds)):  # children come after parents
        if parents[node] == best and total[node] and total[node] >= share * total[0] and kinds[node].split(".")[0] not in FLOW:
            best = node
    return best


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, shape, wrapper, tree to host, shape, node, slot: the node of the wrapper that a node, or its nearest ancestor with a match, has."""
    for batch in batches:
        out = []
        for host, shape, wrapper, tree in zip(*(c.to_pylist() for c in batch.columns)):
            to = align(wrapper, tree)
            for node, above in enumerate(json.loads(tree)[0]):
                to[node] = to[above] if to[node] < 0 else to[node]
                out.append((host, shape, node, to[node]))
        columns = zip(*out) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32()))], ["host", "shape", "node", "slot"])


def wrappers(pages: DataFrame, least_pages: int = LEAST_PAGES, template_share: float = TEMPLATE_SHARE, region_share: float = REGION_SHARE) -> DataFrame:
    """host, wrapper (a tree), region (a node of it), template (slot and text hash of what repeats). pages: host, html."""
    counted = stored(counts(pages), "counts")
    trees = stored(counted.where("node = -1").groupBy("host", "shape").agg(F.sum("n").alias("n"), F.first("tree").alias("tree")), "trees")
    chosen = trees.groupBy("host").agg(F.min(F.struct((-F.col("n")).alias("less"), "shape", "tree")).alias("c"), F.sum("n").alias("pages"))
    chosen = stored(chosen.select("host", F.col("c.tree").alias("wrapper"), "pages"), "wrappers")
    places = stored(trees.join(chosen, "host").select("host", "shape", "wrapper", "tree").mapInArrow(_places, "host string, shape long, node int, slot int"), "places")
    places = F.broadcast(places) if places.count() <= BROADCAST_ROWS else places
    texts = counted.where("node >= 0").groupBy("host", "shape", "node", "text").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    texts = stored(texts.join(places, ["host", "shape", "node"]).groupBy("host", "slot", "text").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")), "texts")
    # what few pages have can't be template, wherever it stands
    repeated = texts.where(F.col("n") >= template_share * least_pages).join(chosen.select("host", "pages"), "host")
    repeated = repeated.where((F.col("pages") >= least_pages) & (F.col("n") >= template_share * F.col("pages")))
    repeated = repeated.groupBy("host", "slot").agg(F.sum("chars").alias("less"), F.collect_list("text").alias("texts"))
    slots = texts.groupBy("host", "slot").agg(F.sum("chars").alias("chars")).join(repeated, ["host", "slot"], "left")
    slots = slots.groupBy("host").agg(F.collect_list(F.struct("slot", (F.col("chars") - F.coalesce("less", F.lit(0))).alias("mass"), "texts")).alias("slots"))

    def region(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            regions = [_region(r["wrapper"], {s["slot"]: s["mass"] for s in r["slots"] or []}, region_share) for r in rows]
            template = [[f"{s['slot']} {t}" for s in r["slots"] or [] for t in s["texts"] or []] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(regions, pa.int32()), pa.array(template, pa.list_(pa.string()))], ["host", "wrapper", "region", "template"])

    return chosen.join(slots, "host", "left").select("host", "wrapper", "slots").mapInArrow(region, "host string, wrapper string, region int, template array<string>")


def main_text(source: str | None, wrapper: str, region: int, template: set[str], aligned: dict | None = None) -> str:
    """The text of one page under its host's wrapper. aligned: keeps alignments by shape."""
    page = Page(source)
    blocks = [b for b in page.blocks if not b[3]]
    if not blocks:
        return ""
    shape, number = page.shape()
    aligned = {} if aligned is None else aligned
    if shape not in aligned:
        aligned[shape] = align(wrapper, shape)
    to = aligned[shape]
    slots = _slots(page, number, to)
    most = max(b[4] for b in blocks)
    if most:
        inside = [b for b in blocks if b[4] == most]
    else:
        home = {number[n]: n for n in number}
        own = {home[k] for k, w in enumerate(to) if w == region}

        def within(node: int) -> bool:
            while node >= 0 and node not in own:
                node = page.parent[node]
            return node >= 0

        inside = [b for b in blocks if within(b[0])] or blocks
    varying = [b for b in inside if f"{slots[b[0]]} {_hash(b[1])}" not in template] if template else inside
    return "\n\n".join(b[1] for b in varying or inside)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, template_share: float = TEMPLATE_SHARE, region_share: float = REGION_SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_column(url_col).alias("host"))
    known = stored(wrappers(pages, least_pages, template_share, region_share), "hosts")
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("wrapper") + 24 * F.size("template")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES:
        known = F.broadcast(known)
    rows = pages.join(known, "host").select("page_id", "url", "html", "host", "wrapper", "region", "template")
    page_id = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for source, host, wrapper, region, template in zip(batch.column(2), *(batch.column(k).to_pylist() for k in (3, 4, 5, 6))):
                if len(kept) > 1000:
                    kept.clear()
                texts.append(main_text(source.as_py(), wrapper, region, set(template or ()), kept.setdefault(host, {})))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {page_id}, url string, text string, n_chars long")

