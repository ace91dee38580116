"""Main text of web pages, without what a site repeats.

Each page is parsed into a tree. Its parts, inside the article and outside, are hashed with their host, and Spark counts
with how many main texts of the host each hash stands; parts that recur with many are the site's template and are deleted
wherever they stand. Articles and main parts themselves stay, and so do paragraphs and headings inside them, which recur
in prose. Of what remains, menus, headers, footers, sidebars, notices, adverts, forms, comments and unseen elements go by tag, role and
class; the text is that of the article (or main part, or else the body), block by block.

Only hashes are counted and shuffled. Hashes of templates are sent to all tasks while their number is small, else they are
joined to the pages that hold them.

Defined results: null or empty html gives an empty text; a null or odd url has no host and no templates; repeated rows
give a row each; broken markup is read as browsers do, roughly: unclosed elements end with what holds them; an empty
table gives no rows. Copies of a page have one main text, so that they make no template.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import quoted, staged, tidy

#: A subtree is part of the template if pages of at least so many main texts, and of this share of the host's, hold it.
MIN_PAGES, MIN_SHARE = 4, 0.01
#: Template hashes that are sent to all tasks at most (8 bytes each).
SENT = 500_000

_set = lambda text: frozenset(text.split())
VOID = _set("area base br col embed hr img input link meta param source track wbr")
BLOCK = _set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul")
UNSEEN = _set("head title script style noscript template iframe object svg math canvas audio video map button select textarea input label datalist dialog form nav aside footer menu search fieldset")
#: Elements that may be a template as a whole.
PARTS = _set("nav header footer aside section div ul ol dl table form details menu figure")
#: Elements that may be one outside the article only.
LOOSE = _set("p blockquote pre h1 h2 h3 h4 h5 h6 hgroup span")
CLOSES = {"li": _set("li"), "dt": _set("dt dd"), "dd": _set("dt dd"), "tr": _set("tr td th"), "td": _set("td th"), "th": _set("td th"), "option": _set("option")}
HOLDS = {"li": _set("ul ol menu"), "dt": _set("dl"), "dd": _set("dl"), "tr": _set("table"), "td": _set("table tr"), "th": _set("table tr"), "option": _set("select datalist")}
#: Parts of a class, id or role that mark what isn't the article.
MARKED = _set(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion promoted banner "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager masthead topbar toolbar skip contentinfo "
    "sidebar sidebars rail widget widgets complementary related recommended recommendations trending popular "
    "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup dialog "
    "comment comments commentlist respond replies disqus footer share sharing social search searchbox login form"
)
OUTSIDE = _set("header head")
MAIN = _set("article main")
LISTED = frozenset().union(CLOSES, *CLOSES.values(), *HOLDS.values())
NOTHING = np.zeros(0, np.int64)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """block and listed: the nearest block (or button), and the nearest part of a list or table, from the element itself upward."""

    __slots__ = ("tag", "parent", "children", "marked", "within", "holds", "block", "listed")

    def __init__(self, tag: str, parent: Node | None, marked: bool):
        self.tag, self.parent, self.children, self.marked = tag, parent, [], marked
        self.within = parent is not None and (parent.within or parent.tag in MAIN)
        self.holds = False  # an article or main part below
        self.block = self if parent is None or tag in BLOCK or tag == "button" else parent.block
        self.listed = self if parent is None or tag in LISTED else parent.listed


def _marks(tag: str, attrs: list[tuple[str, str | None]], within: bool) -> bool:
    if tag in UNSEEN or tag == "header" and not within:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    found: set[str] = set()
    for name, value in attrs:
        value = value or ""
        if name in ("class", "id", "role"):
            found.update(w.lower() for w in WORD.findall(value))
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    if tag == "main" or tag == "article" and not found & {"comment", "comments", "promo", "sponsored", "related"}:
        return False
    return bool(found & MARKED) or not within and bool(found & OUTSIDE)


class Tree(HTMLParser):
    """The elements of a page; script and style are read over. Each tag costs what it opens or ends, however deep it stands."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, False)
        self.open: Counter[str] = Counter()

    def _leave(self, node: Node) -> None:
        """Ends what is open, up to and with node."""
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent
        self.open[node.tag] -= 1
        self.at = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK and self.open["p"] and self.at.block.tag == "p":
            self._leave(self.at.block)
        if tag in CLOSES and any(self.open[t] for t in CLOSES[tag]):
            node, last = self.at.listed, None
            while node.parent is not None and node.tag not in HOLDS[tag]:
                last = node if node.tag in CLOSES[tag] else last
                node = node.parent.listed
            if last is not None:
                self._leave(last)
        node = Node(tag, self.at, _marks(tag, attrs, self.at.within or self.at.tag in MAIN))
        if tag in MAIN:
            above = self.at
            while above is not None and not above.holds:
                above.holds, above = True, above.parent
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            node = self.at
            while node.tag != tag:
                node = node.parent
            self._leave(node)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    # A page is fed whole, so that what the parser calls incomplete is never ended: as in browsers, it goes on to the page's end.
    def _or_end(self, at: int) -> int:
        return at if at >= 0 else len(self.rawdata)

    def parse_starttag(self, i: int) -> int:
        return self._or_end(super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self._or_end(super().parse_endtag(i))

    def parse_comment(self, i: int, report: bool = True) -> int:
        return self._or_end(super().parse_comment(i, report))

    def parse_pi(self, i: int) -> int:
        return self._or_end(super().parse_pi(i))

    def parse_html_declaration(self, i: int) -> int:
        try:
            at = super().parse_html_declaration(i)
        except AssertionError:  # one that HTML doesn't have is a comment
            at = -1
        if at < 0 and not self.rawdata.startswith("<!--", i):
            at = self.parse_bogus_comment(i)
        return self._or_end(at)


def parse(html: str | None) -> Node:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def subtree_hashes(root: Node, host: str) -> dict[int, int]:
    """id of each part that has text and holds no article -> its hash (with the host)."""
    out: dict[int, int] = {}
    done: dict[int, tuple[bytes, int, bool]] = {}
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, seen = stack.pop()
        if not seen:
            stack.append((node, True))
            stack += [(c, False) for c in node.children if isinstance(c, Node)]
            continue
        digest, length, article = blake2b(node.tag.encode(), digest_size=16), 0, node.tag in MAIN
        for c in node.children:
            if isinstance(c, Node):
                d, n, holds = done.pop(id(c))
                digest.update(b"<" + d)
                length, article = length + n, article or holds
            elif words := c.split():
                digest.update(b"t" + " ".join(words).encode("utf-8", "surrogatepass"))
                length += sum(map(len, words))
        done[id(node)] = digest.digest(), length, article
        if (node.tag in PARTS or node.tag in LOOSE and not node.within) and not article and length:
            h = blake2b(host.encode("utf-8", "surrogatepass") + b"\0" + digest.digest(), digest_size=8).digest()
            out[id(node)] = int.from_bytes(h, "little", signed=True)
    return out


def _main(root: Node) -> list[Node]:
    """Articles that no unseen part and no other article holds, or else main parts, or else the whole."""
    for tag in ("article", "main"):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.marked:
                continue
            if node.tag == tag:
                found.append(node)
                continue
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]
        if found:
            return found
    return [root]


def _among(hashes: dict[int, int], templates: np.ndarray) -> set[int]:
    own = np.fromiter(hashes.values(), np.int64, len(hashes))
    at = np.minimum(np.searchsorted(templates, own), len(templates) - 1)
    return {i for i, known in zip(hashes, templates[at] == own) if known}


def extract(html: str | None, host: str = "", templates: np.ndarray = NOTHING) -> str:
    """The main text; templates: sorted hashes of the host's repeated subtrees. A page that is all template keeps its text."""
    root = parse(html)
    repeated = _among(subtree_hashes(root, host), templates) if host and len(templates) else set()
    return _text(root, repeated) or (_text(root, set()) if repeated else "")


def _text(root: Node, repeated: set[int]) -> str:
    blocks: list[str] = []
    run: list[str] = []

    def end() -> None:
        if text := " ".join("".join(run).split()):
            blocks.append(text)
        run.clear()

    for start in _main(root):
        stack: list[Node | str | None] = [start]
        while stack:
            x = stack.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                run.append(x)
            elif x is start or not (x.marked and not (x.tag == "div" and x.holds) or id(x) in repeated):
                if x.tag == "br":
                    run.append(" ")
                if x.tag in BLOCK:
                    end()
                    stack.append(None)
                stack += reversed(x.children)
        end()
    return " ".join(blocks)


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for page, site, host, html in zip(*[b.column(c).to_pylist() for c in ("page_id", "site", "host", "html")]):
            root = parse(html)
            content = blake2b(_text(root, set()).encode("utf-8", "surrogatepass"), digest_size=8).digest()
            # a row without a hash stands for the page
            rows += [(page, site, h, int.from_bytes(content, "little", signed=True)) for h in (None, *set(subtree_hashes(root, host).values()))]
        yield pa.record_batch([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["page_id", "site", "h", "content"])


def hosted(pages: DataFrame) -> DataFrame:
    """page_id, url, host, html."""
    return pages.select(quoted("page_id").cast("long").alias("page_id"), quoted("url").cast("string").alias("url"), host_of("url").alias("host"), quoted("html").cast("string").alias("html"))


def _hashes(rows: DataFrame) -> DataFrame:
    with_host = rows.filter("host <> ''").withColumn("site", F.xxhash64("host"))
    return with_host.select("page_id", "site", "host", "html").mapInArrow(tidy(_hashed), "page_id long, site long, h long, content long")


def templates_of(rows: DataFrame) -> DataFrame:
    """h: the hashes (with their host) of subtrees that recur with many main texts of a host; rows as of hosted(). Staged."""
    counted = staged(_hashes(rows).groupBy("site", "h").agg(F.countDistinct("content").alias("n")).filter(F.col("h").isNull() | (F.col("n") >= MIN_PAGES)), "html-counts")
    sizes = counted.filter("h IS NULL").select("site", F.col("n").alias("all"))
    return staged(counted.filter("h IS NOT NULL").join(sizes, "site").filter(F.col("n") >= F.col("all") * MIN_SHARE).select("h"), "html-templates")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text."""
    rows = hosted(pages)
    templates = templates_of(rows)
    schema = "page_id long, url string, text string"
    if templates.count() <= SENT:
        # SENT numbers of 8 bytes at most
        sent = rows.sparkSession.sparkContext.broadcast(np.unique(templates.toPandas()["h"].to_numpy(np.int64)))

        def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = [extract(html, host, sent.value) for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist())]
                yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

        return rows.mapInArrow(tidy(extracted), schema)
    own = _hashes(rows).join(templates, "h").groupBy(F.col("page_id").alias("of")).agg(F.collect_set("h").alias("own"))

    def extracted_by_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(html, host, np.unique(np.array(own or [], np.int64))) for host, html, own in zip(*[b.column(c).to_pylist() for c in ("host", "html", "own")])]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return rows.join(own, rows["page_id"].eqNullSafe(F.col("of")), "left").select("page_id", "url", "host", "html", "own").mapInArrow(tidy(extracted_by_own), schema)
