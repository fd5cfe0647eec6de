"""HTML main text by nearest-URL page differencing.

A page is read into text lines (blocks between block-level tags), each with what
the markup says of it: part of the article, part of something that is never
article (menus, forms, asides, elements named as adverts, comments, notices and
the like), or neither. Pages are sorted by host, path and page_id, so that a
page's neighbours are the same host's pages with the nearest paths. The lines of
neighbours are aligned by a longest common subsequence; lines that a neighbour
shares are furniture and are deleted. Two things stand against deleting too
much: articles share passages, so a line inside a declared article goes only if
every one of the up to four nearest pages (REACH on each side) shares it, MOST_LIKE
at least; and a neighbour that shares nearly all of a page (of its article, where
one is declared) is a copy of it and deletes nothing. What the markup rules out
goes in any case; where an article is declared, only its lines stay.

Pages are parsed once and go to parts of the order of host, path and page_id, whose
bounds come from a sample of the keys: no host is ever gathered in one task. The
first and last pages of each part meet their neighbours across the boundary in a
second step, one boundary (with the small parts beside it) at a time.

Edge cases: a null or empty page has the empty text. A null url, or one without
``://``, has no neighbours. Equal urls are neighbours by page_id. Very long pages
are aligned whole (a bit vector for each line). Broken markup never raises: of an
unclosed tag only the tag goes. A form around a declared article is like a plain
block. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .urlfilter import host_of, path_of

ARTICLE, OTHER, NEVER = "a", "o", "n"
#: A neighbour that shares this part of a page's (or its article's) characters is a copy.
COPY = 0.8
#: Pages on each side whose lines are compared with an article's.
REACH = 2
#: Neighbours that must share an article's line, and no other may lack it.
MOST_LIKE = 3
#: Keys for each part from which the parts' bounds are taken.
SAMPLE_KEYS = 50

# Element names and the words of class, id and role that mark what is never article.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("script style noscript template iframe svg canvas object select textarea head title math audio video".split())
#: Of these, one that opens again before it closes was never closed.
UNNESTED = set("iframe canvas select textarea title audio video".split())
NEVER_TAGS = set("nav footer aside form button menu dialog fieldset".split())
NEVER_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NEVER_WORDS = set(
    "nav navbar navigation menu sidebar footer masthead breadcrumb breadcrumbs ad ads adv advert adverts advertisement advertising "
    "sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social comment comments commentlist disqus respond reply replies related "
    "recommended recommendations widget widgets toolbar pagination pager search copyright skip alert toc tags outbrain taboola".split()
)
HEADER_WORDS = {"header", "topbar", "site-header"}
#: A class such as ``has-sidebar`` speaks of what is beside the element.
ASIDE_WORDS = {"with", "has", "no", "without", "main", "article"}
CLOSED_BY_BLOCK = {"p"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_tag = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']++)*+)>", re.S)
_attribute = re.compile(r"([a-zA-Z:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_words = re.compile(r"[a-z]+")
_form_end, _article = re.compile(r"</form\s*>", re.I), re.compile(r"<(?:article|main)\b", re.I)


def _kind(tag: str, attributes: str, inside: str) -> str:
    """What an element is, given what it stands in."""
    if inside == NEVER or tag in NEVER_TAGS or (tag == "header" and inside != ARTICLE):
        return NEVER
    if tag in ("html", "body"):
        return inside
    named: dict[str, str] = {}
    if attributes:
        named = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _attribute.finditer(attributes)}
    role = named.get("role", "")
    if tag in ("article", "main") or role in ("main", "article") or named.get("itemprop") == "articlebody":
        if tag == "article" and set(_words.findall(named.get("class", ""))) & {"comment", "comments", "reply"}:
            return NEVER
        return ARTICLE
    if role in NEVER_ROLES or named.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", named.get("style", "")):
        return NEVER
    if attributes and re.search(r"(?:^|\s)hidden(?:\s|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)):
        return NEVER
    for name in ("class", "id"):
        for one in named.get(name, "").split():
            words = set(_words.findall(one))
            if words & ASIDE_WORDS:
                continue
            if words & NEVER_WORDS or (inside != ARTICLE and words & HEADER_WORDS):
                return NEVER
    return inside


def _holds_article(page: str, at: int) -> bool:
    """Whether an article begins before the form that begins at ``at`` ends."""
    stop = _form_end.search(page, at)
    return bool(_article.search(page, at, stop.start() if stop else len(page)))


def lines_of(page: str | None) -> list[tuple[str, str]]:
    """(kind, text) of each block of a page, in order; texts have no runs of white space and aren't empty."""
    out: list[tuple[str, str]] = []
    text: list[str] = []
    stack: list[tuple[str, str]] = []
    page = page or ""
    linked = plain = 0

    def kind() -> str:
        return stack[-1][1] if stack else OTHER

    def close() -> None:
        nonlocal linked, plain
        if text:
            block = " ".join("".join(text).split())
            if block:
                # a line that is all links is a menu unless it is in an article
                out.append((NEVER if kind() == OTHER and linked and not plain else kind(), block))
            text.clear()
        linked = plain = 0

    at, size = 0, len(page)
    while at < size:
        found = _tag.search(page, at)
        end = found.start() if found else size
        if end > at:
            part = html.unescape(page[at:end])
            text.append(part)
            if part.strip():
                if any(t == "a" for t, _ in stack[-3:]):
                    linked += 1
                else:
                    plain += 1
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag not in INLINE:
                close()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if tag in INLINE and stack[depth][1] != kind():
                        close()
                    elif stack[depth][1] == NEVER:
                        close()
                    del stack[depth:]
                    break
            continue
        if tag in SKIPPED:
            if tag not in INLINE:
                close()
            if not found[3].rstrip().endswith("/"):
                stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                if stop and not (tag in UNNESTED and re.compile(rf"<{tag}\b", re.I).search(page, at, stop.start())):
                    at = stop.end()
            continue
        if tag not in INLINE:
            close()
            while stack and (stack[-1][0] in CLOSED_BY_BLOCK or stack[-1][0] in INLINE):
                stack.pop()
            if tag in SIBLINGS and stack and stack[-1][0] in SIBLINGS[tag]:
                stack.pop()
        if tag in VOID or found[3].rstrip().endswith("/"):
            continue
        if tag == "form" and kind() != NEVER and _holds_article(page, at):
            new = kind()
        else:
            new = _kind(tag, found[3].strip(), kind())
        if new != kind():
            close()
        stack.append((tag, new))
    close()
    return out


def common_lines(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by bit vectors over ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    pairs = [(i, i) for i in range(head)]
    left, right = a[head : len(a) - tail], b[head : len(b) - tail]
    where: dict[str, int] = {}
    for j, line in enumerate(right):
        where[line] = where.get(line, 0) | 1 << j
    full = (1 << len(right)) - 1
    v, rows = full, []
    for line in left:
        u = v & where.get(line, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    i, j, middle = len(left), len(right), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not (i and not rows[i - 1] >> (j - 1) & 1):
                j -= 1
                middle.append((head + i, head + j))
    return pairs + middle[::-1] + [(len(a) - t, len(b) - t) for t in range(tail, 0, -1)]


class Page:
    def __init__(self, row: tuple):
        self.page_id, self.url, self.host, self.path, packed = row[:5]
        lines = zstandard.decompress(packed).decode("utf-8", "surrogatepass").split("\n") if len(packed) else []
        self.kinds, self.texts = [x[0] for x in lines], [x[1:] for x in lines]
        self.shared: set[int] = set()
        self.declared = ARTICLE in self.kinds
        self.own = sum(len(t) for t, k in zip(self.texts, self.kinds) if k == (ARTICLE if self.declared else OTHER))
        #: Of an article: how many neighbours, copies left out, share each of its lines, and how many there are.
        self.likes: dict[int, int] = {}
        self.met = 0

    def meet(self, other: Page, apart: int) -> None:
        """Mark in both pages the lines that they share; only articles look further than the next page."""
        if not self.host or self.host != other.host or (apart > 1 and not (self.declared or other.declared)):
            return
        pairs = common_lines(self.texts, other.texts)
        for page, places in ((self, {i for i, _ in pairs}), (other, {j for _, j in pairs})):
            alike = [i for i in places if page.kinds[i] == (ARTICLE if page.declared else OTHER)]
            copy = sum(len(page.texts[i]) for i in alike) >= COPY * page.own
            if page.declared and not copy:
                page.met += 1
                for i in alike:
                    page.likes[i] = page.likes.get(i, 0) + 1
            if apart == 1 and (page.declared or not copy):
                page.shared |= places

    def deleted(self) -> set[int]:
        """The lines that go because neighbours share them."""
        if not self.declared:
            return self.shared
        furniture = {i for i, n in self.likes.items() if n == self.met >= MOST_LIKE}
        return furniture | {i for i in self.shared if self.kinds[i] != ARTICLE}

    def text(self) -> str:
        gone = self.deleted()
        left = [t for i, (k, t) in enumerate(zip(self.kinds, self.texts)) if k == (ARTICLE if self.declared else OTHER) and i not in gone]
        return " ".join(left)

    def row(self) -> tuple:
        text = self.text()
        return self.page_id, self.url, text, len(text), len(self.deleted())


OUT = ["page_id", "url", "text", "n_chars", "n_shared_lines"]


def _met(pages: Iterator[Page]) -> Iterator[Page]:
    """Each page once it has met the REACH pages before and after it."""
    before: list[Page] = []
    for page in pages:
        for apart, other in enumerate(reversed(before), 1):
            other.meet(page, apart)
        before.append(page)
        if len(before) > REACH:
            yield before.pop(0)
    yield from before


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > 8_000_000:
            yield pd.DataFrame(held, columns=OUT)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=OUT)


def _key(host: str, path: str, page_id: object) -> tuple:
    """The order of pages; a page without an id comes first."""
    none = page_id is None or page_id != page_id
    return host, path, not none, 0 if none else page_id


def _bounds(rows: DataFrame, parts: int) -> list[tuple]:
    """Where parts of about the same number of pages begin, from about SAMPLE_KEYS keys for each part."""
    share = min(1.0, SAMPLE_KEYS * parts / max(1, rows.count()))
    some = rows.select("host", "path", "page_id").where(F.pmod(F.xxhash64("host", "path", "page_id"), F.lit(1 << 20)) < share * (1 << 20))
    keys = sorted(_key(*r) for r in some.collect())
    return sorted({keys[len(keys) * k // parts] for k in range(1, parts)}) if keys else []


def _parse(bounds: list[tuple]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=6).compress
        for pdf in batches:
            packed = []
            for page in pdf["html"]:
                lines = "\n".join(k + t for k, t in lines_of(page))
                packed.append(pack(lines.encode("utf-8", "surrogatepass")) if lines else b"")
            part = [bisect_right(bounds, _key(*k)) for k in zip(pdf["host"], pdf["path"], pdf["page_id"])]
            yield pdf[["page_id", "url", "host", "path"]].assign(part=part, packed=packed)[["part", "page_id", "url", "host", "path", "packed"]]

    return run


#: Of an edge page: in the first pages of its partition, in the last, or in a partition too small to tell.
FIRST, LAST, SMALL = range(3)
INSIDE = 2 * REACH


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The parts of a task one by one; rows come sorted by part."""
    stream = (row for pdf in batches for row in pdf.itertuples(index=False, name=None))
    for part, rows in groupby(stream, key=itemgetter(0)):
        yield from _swept(int(part), rows)


def _swept(part: int, rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """The results of all pages of a part but its first and last REACH; its first and last INSIDE pages, packed."""
    first, last, n = [], [], 0

    def raw() -> Iterator[tuple]:
        nonlocal n
        for row in rows:
            first.append(row[1:]) if n < INSIDE else last.append(row[1:])
            del last[:-INSIDE]
            n += 1
            yield row[1:]

    held: list[Page] = []
    out: list[tuple] = []
    size = 0
    for k, page in enumerate(_met(map(Page, raw()))):
        if k >= REACH:
            held.append(page)
        if len(held) > REACH:
            # done only if the part turns out to be large; the first INSIDE wait for that
            row = held.pop(0).row()
            out.append((0, part, 0, *row, None, None, None))
            size += len(row[2])
            if size > 8_000_000 and n >= 2 * INSIDE:
                yield pd.DataFrame(out, columns=SWEPT)
                out, size = [], 0
    large = n >= 2 * INSIDE
    edges = [(FIRST, r) for r in first] + [(LAST, r) for r in last] if large else [(SMALL, r) for r in [*first, *last]]
    out = (out if large else []) + [(1, part, side, r[0], r[1], None, None, None, *r[2:]) for side, r in edges]
    if out:
        yield pd.DataFrame(out, columns=SWEPT)


SWEPT = ["edge", "part", "side", *OUT, "host", "path", "packed"]


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The results of the pending pages of each boundary; rows come sorted by boundary."""

    def groups() -> Iterator[list[tuple]]:
        at, held = None, []
        for pdf in batches:
            for row in pdf.itertuples(index=False, name=None):
                if held and row[0] != at:
                    yield held
                    held = []
                at = row[0]
                held.append(row)
        if held:
            yield held

    def rows() -> Iterator[tuple]:
        for group in groups():
            before, after = ([r for r in group if r[1] == side] for side in (LAST, FIRST))
            pending = {id(r) for r in [*before[-REACH:], *after[:REACH], *(r for r in group if r[1] == SMALL)]}
            for row, page in zip(group, _met(Page(r[2:]) for r in group)):
                if id(row) in pending:
                    yield page.row()

    return _frames(rows())


def _boundaries(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """part, side, boundary: which boundary an edge belongs to; a row or two for each partition."""
    number, rows = 0, []
    for r in sorted(edges.groupBy("part").agg(F.max("side").alias("side")).collect(), key=lambda r: r.part):
        if r.side == SMALL:
            rows.append((r.part, SMALL, number))
        else:
            rows += [(r.part, FIRST, number), (r.part, LAST, number + 1)]
            number += 1
    return spark.createDataFrame(rows, "part int, side int, boundary int")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared_lines (deleted as shared with a neighbour)."""
    spark, kind = pages.sparkSession, dict(pages.dtypes)["page_id"]
    url = F.coalesce("url", F.lit(""))
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), "html")
    bounds = _bounds(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parsed = rows.mapInPandas(_parse(bounds), f"part int, page_id {kind}, url string, host string, path string, packed binary")
    ordered = parsed.repartition("part").sortWithinPartitions("part", "host", "path", "page_id")
    found = f"page_id {kind}, url string, text string, n_chars long, n_shared_lines long"
    swept = ordered.mapInPandas(_sweep, f"edge int, part int, side int, {found}, host string, path string, packed binary")
    swept = materialize(spark, swept, "swept", by="edge")
    edges = swept.where("edge = 1")
    at = edges.join(F.broadcast(_boundaries(spark, edges)), ["part", "side"])
    at = at.select("boundary", "side", "page_id", "url", "host", "path", "packed").repartition("boundary")
    across = at.sortWithinPartitions("boundary", "host", "path", "page_id").mapInPandas(_across, found)
    return swept.where("edge = 0").select(*OUT).unionByName(across)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``pages``: page_id, url, text, n_chars, n_shared_lines."""
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op2_main_text": op2_main_text}
ORACLE_SQL: dict[str, str] = {}
