"""Page text by differencing neighbours."""

import random

import pytest

from shardwise.llm import page_diff
from shardwise.llm.common import table

from ..conftest import TESTDATA

PAGES = "page_id LONG, url STRING, html STRING"


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, PAGES).repartition(parts).selectExpr(
        "*", "1 as gone", "2 as d1", "'h' as host", "'t' as text", "3 as row_idx", "4 as n_chars")
    out = page_diff.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = [(r.page_id, r.url, r.text) for r in out.collect() if r.n_chars == len(r.text)]
    assert len(got) == len(rows)
    return sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2]))


def lcs_length(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@pytest.mark.parametrize("small,often", [(1 << 26, 64), (16, 1), (0, 3)])
def test_common_lines_are_a_longest_common_subsequence(monkeypatch, small, often):
    monkeypatch.setattr(page_diff, "SMALL", small)
    monkeypatch.setattr(page_diff, "OFTEN", often)
    rng = random.Random(5)
    for _ in range(400):
        letters = rng.choice([2, 4, 30])
        a = [rng.randrange(letters) for _ in range(rng.randrange(30))]
        b = [rng.randrange(letters) for _ in range(rng.randrange(30))]
        if rng.random() < 0.3:
            b = a[:5] + b + a[5:]
        found = page_diff.common_lines(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p < r and q < s for (p, q), (r, s) in zip(found, found[1:]))
        assert len(found) == lcs_length(a, b)


def test_long_pages_of_repeated_and_of_different_lines():
    n = 30_000
    a, b = list(range(n)), list(range(n // 2)) + [-1] * 500 + list(range(n // 2 + 7, n))
    assert len(page_diff.common_lines(a, b)) == n - 7
    rng = random.Random(1)
    x, y = [rng.randrange(3) for _ in range(n)], [rng.randrange(3) for _ in range(n)]
    found = page_diff.common_lines(x, y)
    assert n // 2 < len(found) < n and all(x[i] == y[j] for i, j in found)


ARTICLE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var a="</p><article>x";</script>
</head><body class="has-menu"><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad-slot">Buy</div><article class="post"><header><h1>Head  line &eacute;</h1><p>by Ann</p></header>
<p><b>One&nbsp;two<br>three &lt;3 &amp;amp; &am 1 < 2<p>Four <i>fi</i>ve <span class="promo">win</span> six.</p></b>
<aside>more</aside><form>mail<input value="x>y"></form><p title="a > b">Seven</p><ul><li><a href="/x">link</a><li>item</ul>
<section id="userComments"><article>nice!</article></section><table><tr><td>c1<td>c2</table></article>
<div class="cookie_notice">Cookies</div><div role="complementary">side</div><footer>&copy; 1</footer>"""
ARTICLE_TEXT = "Head line é\nOne two three <3 &amp; &am 1 < 2\nFour five\nsix.\nSeven\nlink\nitem\nc1\nc2"


def test_markup_alone(spark):
    rows = [(1, "http://one.org/a", ARTICLE), (2, None, ARTICLE), (3, "no host", "plain  text"), (4, "http://x.org", None),
            (5, "http://y.org", ""), (6, "http://z.org/q", "<p>a<p>b<div>c</div>d<script>e"), (None, "u", "<b>q</b>r")]
    assert run(spark, rows) == [
        (1, "http://one.org/a", ARTICLE_TEXT), (2, None, ARTICLE_TEXT), (3, "no host", "plain text"),
        (4, "http://x.org", ""), (5, "http://y.org", ""), (6, "http://z.org/q", "a\nb\nc\nd"), (None, "u", "qr")]


def plain(*lines):
    return "<body>" + "".join(f"<div>{line}</div>" for line in lines) + "</body>"


def test_neighbours_share_their_site(spark):
    site = ["Welcome to our pages", "Latest offers of the week", "All rights reserved by us"]
    body = [[f"story {i} line {k} with some words of its own {i * 7 + k}" for k in range(4)] for i in range(6)]
    rows = [(i, f"http://Site.example/news/{i}.html?x={i}#f", plain(site[0], *body[i], site[1], f"extra {i}", site[2]))
            for i in range(6)]
    want = [(i, rows[i][1], "\n".join([*body[i], f"extra {i}"])) for i in range(6)]
    assert run(spark, rows) == want
    assert run(spark, rows, 1) == want
    # the same lines on other hosts are none of this site's; a page alone keeps all
    alone = [(9, "http://other.example/news/3", plain(site[0], "only"))]
    assert run(spark, rows + alone) == want + [(9, alone[0][1], site[0] + "\nonly")]
    # equal rows get equal texts
    assert run(spark, rows + rows) == sorted(want + want)


def test_marked_articles_keep_passages_that_neighbours_quote(spark):
    quote = "a licence line that very many documents of this site hold"

    def page(i):
        return (f"<body><div>our site says hello</div><article><h1>Head {i}</h1><p>{quote}</p><p>own words {i} "
                + f"{i * 3} " * 60 + f"</p></article><div>hello again {i}</div>")

    got = run(spark, [(i, f"http://s.example/{i}", page(i)) for i in range(4)])
    for i, _, text in got:
        assert text == f"Head {i}\n{quote}\nown words {i} " + " ".join([str(i * 3)] * 60) + f"\nhello again {i}"


def test_copies_delete_nothing(spark):
    lines = [f"a line of the copied story {k}" for k in range(5)]
    rows = [(i, f"http://c.example/{i}", plain(*lines)) for i in range(4)]
    assert [t for _, _, t in run(spark, rows)] == ["\n".join(lines)] * 4


def test_hostile_markup_is_read_in_time():
    for source in ("<a" * 200_000, "<a =\"" * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<!--" * 100_000,
                   "<p><b>" * 50_000 + "x", "<div>" * 20_000 + "x" + "</p>" * 20_000, "</div>" * 100_000 + ">"):
        page_diff.parse(source)


def test_empty_table_and_given_pages(spark):
    assert page_diff.extract(spark.createDataFrame([], PAGES)).count() == 0
    pages = table(spark, f"{TESTDATA}/sf0.001", "pages")
    texts = {r.page_id: r.text for r in page_diff.extract(pages).collect()}
    for r in pages.collect():
        assert r.html.count("<article>") == 1
        inner = r.html.split("<article>")[1].split("</article>")[0]
        import html
        import re

        blocks = re.split(r"</?(?:p|h1)>", inner)
        want = [" ".join(html.unescape(re.sub(r"</?(?:b|br)>", "", b)).split()) for b in blocks]
        assert texts[r.page_id] == "\n".join(w for w in want if w)
