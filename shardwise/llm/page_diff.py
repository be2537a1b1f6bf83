"""Main text of web pages by differencing pages of neighbouring URLs.

Every page becomes text lines, one per block, each with the part of the page it
stands in. Pages of a host are ordered by URL path; a page is paired with the
one before it and the one behind it. The lines of a pair are aligned by their
longest common subsequence, and shared lines are what the site repeats: they are
deleted.

What markup says outright goes first: lines inside an ``<article>`` or
``<main>`` element belong to the text, also when a neighbouring article quotes
the same passage, and lines of menus, headers, footers, sidebars, notices,
adverts, forms and comments (by element, role or class name) do not.
Differencing decides about all other lines. A neighbour that shares at least
half of a page's article text (nine tenths of all its text where markup names no
article) is a copy of the page and shows nothing about its site, so it deletes
nothing.

Only 64-bit line hashes travel for the pairs; pages themselves are read where
they are and meet nothing but the positions of their deleted lines.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rowindex import with_row_index
from .common import column_blocks, materialize

# Fixed values of HTML: elements without text of the page, blocks, elements without an end tag.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title "
                   "textarea select datalist button".split())
RAW = frozenset("script style textarea title iframe noscript".split())
CHROME = frozenset("nav footer aside form dialog menu".split())
CONTENT = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
                   "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
                   "p pre search section summary table tbody td tfoot th thead tr ul".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
# Words that class names of such parts begin or end with.
CHROME_NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion "
                         "sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead footer "
                         "cookie cookies consent gdpr notice notices notification popup modal newsletter subscribe "
                         "login signup search share sharing social related recommended recommendations comment "
                         "comments reply replies disqus discussion widget toolbar pager pagination".split())
NAME_DENIED = frozenset("has no with without is not".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

OTHER, TEXT, SITE = 0, 1, 2  # what markup says of a line


def chrome_name(value: str) -> bool:
    """A class or id that names a menu, advert, comment list or the like by its first or last word."""
    for name in value.split():
        words = [w.lower() for w in WORDS.findall(name) if not w.isdigit()]
        if words and words[0] not in NAME_DENIED and (words[0] in CHROME_NAMES or words[-1] in CHROME_NAMES):
            return True
    return False


class Page:
    """The lines of a page and what markup says of each; one pass over its tags."""

    def __init__(self, source: str):
        self.lines: list[str] = []
        self.kinds: list[int] = []
        self.words: list[str] = []
        # Open elements: name, what markup says inside, whether silent, whether in a link.
        self.open: list[tuple[str, int, bool, bool]] = []
        self.names: Counter = Counter()
        self.linked = self.plain = False
        at, last = 0, source.rfind(">")
        while at <= last:
            tag = TAG.search(source, at)
            if tag is None:
                break
            self.text(source[at:tag.start()])
            at = tag.end()
            name = (tag[2] or "").lower()
            if tag[1]:
                self.close(name)
            elif name:
                self.start(name, tag[3])
                if name in RAW:
                    closing = re.compile(f"</{name}(?=[\\s/>])", re.I).search(source, at)
                    at = closing.start() if closing else len(source)
        self.text(source[at:])
        self.flush()

    def now(self) -> tuple[int, bool, bool]:
        return self.open[-1][1:] if self.open else (OTHER, False, False)

    def text(self, raw: str) -> None:
        _, silent, link = self.now()
        if raw and not silent:
            self.words.append(html.unescape(raw) if "&" in raw else raw)
            if not raw.isspace():
                if link:
                    self.linked = True
                else:
                    self.plain = True

    def flush(self) -> None:
        """End the present line."""
        if self.words:
            line = " ".join("".join(self.words).split())
            if line:
                kind = self.now()[0]
                if kind == OTHER and self.linked and not self.plain and self.names["li"]:
                    kind = SITE  # an item of a list that is nothing but a link
                self.lines.append(line)
                self.kinds.append(kind)
            self.words.clear()
        self.linked = self.plain = False

    def start(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self.flush()
            self.end_implied(name)
        elif name == "br" and self.words:
            self.words.append(" ")
        if name in VOID:
            return
        kind, silent, link = self.now()
        inside = kind
        if kind != SITE:
            values: dict[str, str] = {}
            if "=" in attributes:
                for m in ATTRIBUTE.finditer(attributes):
                    values.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
            named = any(chrome_name(values[k]) for k in ("class", "id") if k in values)
            if name in CHROME or values.get("role", "").lower() in CHROME_ROLES or name == "header" and kind != TEXT:
                inside = SITE
            elif name in CONTENT:
                inside = SITE if kind == TEXT and named else TEXT
            elif named and name not in ("html", "body") and not (kind == TEXT and name in HEADINGS):
                inside = SITE
            elif name == "header":
                inside = SITE  # of an article: only its headings are text
            if inside != kind:
                self.flush()
        elif name in HEADINGS and self.open[-1][0] == "header" and self.in_article_header():
            inside = TEXT
        self.names[name] += 1
        self.open.append((name, inside, silent or name in SILENT, link or name == "a"))

    def in_article_header(self) -> bool:
        return len(self.open) > 1 and self.open[-2][1] == TEXT

    def drop(self, place: int) -> None:
        """Close the elements from ``place`` on."""
        if self.open[-1][1] != (self.open[place - 1][1] if place else OTHER):
            self.flush()
        for element in self.open[place:]:
            self.names[element[0]] -= 1
        del self.open[place:]

    def end_implied(self, name: str) -> None:
        """A block ends an open paragraph, an item the open item of its list."""
        for i in range(len(self.open) - 1, -1, -1):
            own = self.open[i][0]
            if own == "p" or own == name == "li":
                self.drop(i)
                return
            if own in BLOCKS:
                return

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        if not self.names[name]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                self.drop(i)
                return
            if name not in BLOCKS and self.open[i][0] in BLOCKS:
                return  # an inline end tag closes no block


def parse(source: str | None) -> Page:
    return Page(source or "")


def line_hashes(lines: list[str]) -> list[int]:
    """Signed 64-bit hashes."""
    return [xxhash.xxh64_intdigest(line) - (1 << 63) for line in lines]


# ------------------------------------------------------------- common lines

SMALL = 1 << 26  # cells (bits) of the table that may be held at once
OFTEN = 64  # places of a line from which its bits are kept


class Bits:
    """For a line, the bits of its places in a list; those of rare lines are made when asked for."""

    def __init__(self, lines: list):
        self.places: dict = {}
        for j, line in enumerate(lines):
            self.places.setdefault(line, []).append(j)
        self.kept = {line: self.make(where) for line, where in self.places.items() if len(where) > OFTEN}

    @staticmethod
    def make(where: list[int]) -> int:
        bits = bytearray((where[-1] >> 3) + 1)
        for j in where:
            bits[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(bits, "little")

    def __getitem__(self, line) -> int:
        kept = self.kept.get(line)
        if kept is None:
            where = self.places.get(line)
            kept = self.make(where) if where else 0
        return kept


def table_rows(x: list, y: list):
    """Rows of the table of common subsequence lengths, a clear bit where the length grows by one."""
    bits, full = Bits(y), (1 << len(y)) - 1
    row = full
    for line in x:
        both = row & bits[line]
        row = ((row + both) | (row - both)) & full
        yield row


def last_lengths(x: list, y: list) -> np.ndarray:
    """Length of the longest common subsequence of ``x`` with every beginning of ``y``."""
    row = (1 << len(y)) - 1
    for row in table_rows(x, y):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits[:len(y)].astype(np.int64))])


def common_lines(a: list, b: list) -> list[tuple[int, int]]:
    """Places ``(i, j)`` of a longest common subsequence of two lists, in bounded memory.

    Lines that the other list lacks are left out first and equal ends are taken
    as they are. The rest is a table of bits, cut in halves while it is large.
    """
    in_a, in_b = set(a), set(b)
    work = [([i for i, line in enumerate(a) if line in in_b], [j for j, line in enumerate(b) if line in in_a])]
    found: list[tuple[int, int]] = []
    while work:
        p, q = work.pop()
        shorter, head = min(len(p), len(q)), 0
        while head < shorter and a[p[head]] == b[q[head]]:
            head += 1
        tail = 0
        while tail < shorter - head and a[p[-1 - tail]] == b[q[-1 - tail]]:
            tail += 1
        found.extend(zip(p[:head], q[:head]))
        found.extend(zip(p[len(p) - tail:], q[len(q) - tail:]))
        p, q = p[head:len(p) - tail], q[head:len(q) - tail]
        if not p or not q:
            continue
        x, y = [a[i] for i in p], [b[j] for j in q]
        if len(x) == 1:
            if x[0] in y:
                found.append((p[0], q[y.index(x[0])]))
        elif len(x) * len(y) <= SMALL:
            rows, i, j = list(table_rows(x, y)), len(x) - 1, len(y) - 1
            while i >= 0 and j >= 0:
                if x[i] == y[j]:
                    found.append((p[i], q[j]))
                    i, j = i - 1, j - 1
                elif rows[i] >> j & 1:
                    j -= 1
                else:
                    i -= 1
        else:
            half = len(x) // 2
            both = last_lengths(x[:half], y) + last_lengths(x[half:][::-1], y[::-1])[::-1]
            cut = int(np.argmax(both))
            work.append((p[:half], q[:cut]))
            work.append((p[half:], q[cut:]))
    return sorted(found)


# ------------------------------------------------------------------- pages

def shared_lines(hashes: list[int], sizes: list[int], undecided: list[bool], other: list[int]) -> list[int]:
    """Places of a page's undecided lines that its neighbour shares; none if the neighbour is a copy of it."""
    common = [i for i, _ in common_lines(hashes, other)]
    article = sum(size for size, u in zip(sizes, undecided) if not u)
    if article:
        copy = 2 * sum(sizes[i] for i in common if not undecided[i]) >= article
    else:
        copy = 10 * sum(sizes[i] for i in common) >= 9 * sum(sizes)
    return [] if copy else [i for i in common if undecided[i]]


def page_lines(batches):
    """Line hashes of pages, without the lines that markup gives to the site."""
    for batch in column_blocks(batches):
        hashes, sizes, undecided = [], [], []
        for source in batch.column("html").to_pylist():
            page = parse(source)
            kept = [i for i, kind in enumerate(page.kinds) if kind != SITE]
            hashes.append(line_hashes([page.lines[i] for i in kept]))
            sizes.append([len(page.lines[i]) for i in kept])
            undecided.append([page.kinds[i] == OTHER for i in kept])
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in ("d1", "d2", "host", "path")]
            + [pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int32())),
               pa.array(undecided, pa.list_(pa.bool_()))],
            names=["d1", "d2", "host", "path", "hashes", "sizes", "undecided"])


def differences(batches):
    """Pairs of neighbours to the places of the lines that the first one loses."""
    for batch in column_blocks(batches):
        gone = [shared_lines(*row) for row in
                zip(*(batch.column(c).to_pylist() for c in ("hashes", "sizes", "undecided", "other")))]
        out = pa.RecordBatch.from_arrays([batch.column("d1"), batch.column("d2"), pa.array(gone, pa.list_(pa.int32()))],
                                         names=["d1", "d2", "gone"])
        yield out.filter(pa.array([bool(g) for g in gone], pa.bool_()))


def main_text(source: str | None, gone: list[int] | None) -> str:
    """The lines of a page that neither markup nor its neighbours give to the site."""
    page = parse(source)
    kept = [line for line, kind in zip(page.lines, page.kinds) if kind != SITE]
    if gone:
        lost = set(gone)
        kept = [line for i, line in enumerate(kept) if i not in lost]
    return "\n".join(kept)


def texts(batches):
    for batch in column_blocks(batches):
        out = [main_text(*row) for row in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()),
             pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``page_id, url, html``.

    A null html is an empty page. A page without a host in its url has no
    neighbours, so markup alone decides about it; nor has the only page of a
    host. The query string, fragment, ending slash and ``.html`` of a url are
    no part of its path; pages of the same path follow one another. Equal rows
    count once as neighbours and get the same text. Null or repeated ids change
    nothing, other columns are ignored, and an empty table gives no rows. Pages
    are read whole, whatever their length.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    bare = F.regexp_replace(url, r"(?s)[?#].*\z", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:]*)", 1))
    path = F.regexp_replace(F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), r"(?:\.html?)?/*\z", "")
    own = [F.col("page_id"), F.col("url"), F.col("html"), F.col("url").isNull(), F.col("html").isNull()]
    rows = pages.select("page_id", "url", "html", F.xxhash64(*own).alias("d1"), F.xxhash64(F.lit(1), *own).alias("d2"))
    with_host = rows.select("d1", "d2", host.alias("host"), path.alias("path"), "html").where("host <> ''")
    lines = with_host.mapInArrow(
        page_lines, "d1 long, d2 long, host string, path string, hashes array<long>, sizes array<int>, "
                    "undecided array<boolean>")
    lines = materialize(lines.dropDuplicates(["d1", "d2"]), "pages")
    placed = with_row_index(lines, ["host", "path", "d1", "d2"])
    pairs = None
    for step in (1, -1):
        other = placed.select((F.col("row_idx") + step).alias("row_idx"), "host", F.col("hashes").alias("other"))
        found = placed.where(F.exists("undecided", lambda u: u)).join(other, ["row_idx", "host"])
        found = found.select("d1", "d2", "hashes", "sizes", "undecided", "other")
        pairs = found if pairs is None else pairs.union(found)
    gone = pairs.mapInArrow(differences, "d1 long, d2 long, gone array<int>").groupBy("d1", "d2").agg(
        F.flatten(F.collect_list("gone")).alias("gone"))
    gone = materialize(gone, "pages")
    kinds = dict(pages.dtypes)
    return rows.join(gone, ["d1", "d2"], "left").select("page_id", "url", "html", "gone").mapInArrow(
        texts, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
