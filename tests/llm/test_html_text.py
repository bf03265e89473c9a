"""Main text of pages: the tables' pages against a plain parser, wrappers of pages without marks, and the defined cases."""

from __future__ import annotations

import json
import random
from html.parser import HTMLParser

import pytest

from flowsift.llm import html_text
from flowsift.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, host string, text string, n_chars string, wrapper int, template int"


class _Article(HTMLParser):
    """Blocks of the article element: headings and paragraphs, whose end tags may be missing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("h1", "p"):
            self.blocks.append("")
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        if tag in ("h1", "p"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def _plain(source: str) -> str:
    parser = _Article()
    parser.feed(source)
    parser.close()
    return "\n\n".join(t for t in (" ".join(b.split()) for b in parser.blocks) if t)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_plain_parser(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").toPandas()
    got = QUERIES["op13_html_extraction"](spark, f"/root/testdata/{sf}").toPandas()
    assert sorted(got.columns) == ["n_chars", "page_id", "text", "url"]
    want = {i: (u, _plain(h)) for i, u, h in zip(pages.page_id, pages.url, pages.html)}
    assert {i: (u, t) for i, u, t in zip(got.page_id, got.url, got.text)} == want
    assert (got.n_chars == got.text.map(len)).all()


def _words(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(n))


def _unmarked(r: random.Random) -> tuple[str, str]:
    """A page of divisions without telling names, and its text."""
    body = [_words(r, r.randrange(20, 50)) for _ in range(r.randrange(2, 9))]
    html = f"<html><body><div><div>Site of things</div><ul><li><a href=/a>Home</a><li><a href=/b>About us</a></ul></div><div><div><h1>{body[0][:30]}</h1>"
    html += "".join(f"<p>{b}" for b in body) + "<p>All rights and wrongs reserved by the owners of this place</div><div><b>Latest</b> things and more of them</div></div><div>Made with care</div></body></html>"
    return html, "\n\n".join([" ".join(body[0][:30].split()), *body])


def test_wrapper_of_pages_without_marks(spark):
    r = random.Random(6)
    made = [_unmarked(r) for _ in range(30)]
    rows = [(i, f"http://one.example/{i}", h, "h", "t", "n", 1, 2) for i, (h, _) in enumerate(made)]
    rows += [(100 + k, "http://copies.example/", rows[0][2], "h", "t", "n", 1, 2) for k in range(8)]
    got = {x["page_id"]: x["text"] for x in html_text.extract(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert {i: got[i] for i in range(30)} == {i: t for i, (_, t) in enumerate(made)}
    # copies of one page are no template of each other: what is said once on every page of a host stays
    assert all(made[0][1] in got[100 + k] for k in range(8))


CASES = {
    "<article><header><h1>A &amp; B</h1><p class=byline>By me</p></header><p>One<br>two&nbsp; three <b>bold</b></p><aside>no</aside><p>Four <span class='ad'>buy</span>five</article><footer>no</footer>": "A & B\n\nOne two three bold\n\nFour five",
    "<header><h1>Site</h1></header><main class='main-content with-sidebar'><p>In<div class=cookie-notice>no</div>side</p></main><div id=comments><article>no</article></div>": "In\n\nside",
    "<body><div>first<script>var a = '</div>'</script> still<!-- no --></div><form><p>no</p></form><noscript>no</noscript><ul><li>x<li>y</ul>": "first still\n\nx\n\ny",
    "<article><p>a < b &lt;c&gt; &#x41;&notanentity; &am<p hidden>no<p style='display: none'>no<p>z</article>": "a < b <c> A&notanentity; &am\n\nz".replace("&notanentity;", "¬anentity;"),
    "<main><p>outer</p><article>text <a href='x>y'>link</a></article><section class='reader-comments'><article>no</article></section></main>": "text link",
    "<table><tr><td>a<td>b<tr><td>c</table><h2>d<h3>e": "a\n\nb\n\nc\n\nd\n\ne",
    "plain words, no markup": "plain words, no markup",
    "<p>cut off in a tag <a href='http": "cut off in a tag",
    "<p>before<!-- never closed <p>no": "before",
    "<div class='header'>no</div><div role=navigation>no</div><p id=related>yes<h2 id=share>yes": "yes\n\nyes",
    "": "",
}


@pytest.mark.parametrize("source", CASES)
def test_marks_and_odd_markup(source):
    page = html_text.Page(source)
    assert html_text.main_text(source, page.shape()[0], 0, set()) == CASES[source]


def test_odd_pages(spark):
    deep = "<div>" * 5000 + "bottom" + "<b>" * 3000
    rows = [(1, None, None), (2, None, ""), (3, "no address", "<p>x"), (None, "http://u@h.example:80/p", "<p>y"), (4, "http://H.example", "<p>y"), (4, "http://H.example", "<p>y"), (5, "http://deep.example", deep), (6, "http://wide.example", "<p>w</p>" * 3 + "<div><p>v</p></div>" * 700), (7, "http://long.example", "z " * 400_000)]
    df = spark.createDataFrame([(*r, "h", "t", "n", 1, 2) for r in rows], SCHEMA)
    got = sorted(((r["page_id"] or 0, r["url"], r["text"][:6], r["n_chars"]) for r in html_text.extract(df).collect()), key=str)
    texts = {1: "", 2: "", 3: "x", 0: "y", 4: "y", 5: "bottom", 6: "w\n\nw\n\nw\n\n" + "\n\n".join(["v"] * 700), 7: " ".join(["z"] * 400_000)}
    assert got == sorted(((i or 0, u, texts[i or 0][:6], len(texts[i or 0])) for i, u, _ in rows), key=str)
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_alignment_is_the_largest():
    r = random.Random(8)

    def tree(n):
        parents, kinds = [-1], ["#"]
        for k in range(1, n):
            parents.append(r.randrange(max(0, k - 3), k))
            kinds.append(r.choice("abc"))
        order, todo, number = [], [0], {}
        while todo:
            x = todo.pop()
            number[x] = len(order)
            order.append(x)
            todo += [c for c in range(n - 1, 0, -1) if parents[c] == x]
        return json.dumps([[-1 if parents[x] < 0 else number[parents[x]] for x in order], [kinds[x] for x in order]])

    def most(a, b):  # plain recursion over child sequences
        (ka, ca), (kb, cb) = a, b
        if ka != kb:
            return 0

        def rest(i, j):
            return 0 if i == len(ca) or j == len(cb) else max(rest(i + 1, j), rest(i, j + 1), (most(ca[i], cb[j]) and most(ca[i], cb[j]) + rest(i + 1, j + 1)))

        return 1 + rest(0, 0)

    def nested(shape, node=0):
        parents, kinds = json.loads(shape)
        return kinds[node], [nested(shape, c) for c, p in enumerate(parents) if p == node]

    for _ in range(60):
        a, b = tree(r.randrange(1, 9)), tree(r.randrange(1, 9))
        to = html_text.align(a, b)
        pairs = [(x, y) for y, x in enumerate(to) if x >= 0]
        (pa, ka), (pb, kb) = json.loads(a), json.loads(b)
        assert len(pairs) == most(nested(a), nested(b))
        assert all(ka[x] == kb[y] and (y == 0 or to[pb[y]] == pa[x]) for x, y in pairs)
        assert [x for x, _ in pairs] == sorted({x for x, _ in pairs})


def test_wide_trees_are_aligned_as_narrow_ones():
    r = random.Random(9)
    kinds = [[r.choice("abc") for _ in range(n)] for n in (560, 570)]
    shapes = [json.dumps([[-1] + [0] * len(k), ["#", *k]]) for k in kinds]
    row = [0] * (len(kinds[1]) + 1)
    for a in kinds[0]:  # longest common subsequence
        above, row = row, [0]
        for k, b in enumerate(kinds[1]):
            row.append(above[k] + 1 if a == b else max(above[k + 1], row[k]))
    to = html_text.align(*shapes)
    pairs = [(a, b) for b, a in enumerate(to) if a > 0]
    assert len(pairs) == row[-1] and pairs == sorted(pairs) and len({a for a, _ in pairs}) == len(pairs)
    assert all(kinds[0][a - 1] == kinds[1][b - 1] for a, b in pairs)


def test_alignment_with_little_memory(monkeypatch):
    r = random.Random(10)

    def shape(n):
        parents, kinds = [-1], ["#"]
        for _ in range(n):
            parents.append(0)
            kinds.append(r.choice("ab"))
            node = len(kinds) - 1
            for _ in range(r.randrange(3)):
                parents.append(node)
                kinds.append(r.choice("ab"))
        return json.dumps([parents, kinds])

    shapes = shape(90), shape(80)
    whole = html_text.align(*shapes)
    monkeypatch.setattr(html_text, "HELD_PAIRS", 3)
    monkeypatch.setattr(html_text, "HELD_CELLS", 200)
    assert html_text.align(*shapes) == whole and sum(k >= 0 for k in whole) > 100
