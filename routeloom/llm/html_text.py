"""Main text of web pages by consensus host paths.

1. Every page scores its containers by the text that stands in them, and names them by their path of tags and classes, with digits
   generalised.
2. Spark adds the votes up per host and path; each host keeps the path with most.
3. Every page is read again: its text is what stands in the containers with its host's path, each widened to the nearest article or main
   around it, or without such to the outermost element whose further text is little linked and not in another article. A page
   without such a container falls back to its own best one.

Within a container, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out, by
tag, role or words of class and id; a header inside an article is its own heading and stays. Character references are decoded, white space inside a block becomes one space, and blocks are
joined by an empty line in page order.

Defined results: null and empty pages have an empty text. A null or unreadable address belongs to the host ``""``. Broken markup is
read as browsers do where it matters: unclosed paragraphs and items end at the next one, unmatched end tags are ignored, an unclosed
comment or script runs to the end. Ties go to the smaller path. Repeated rows get equal results; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import kept

# How HTML groups its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
CONTAINERS = frozenset("html body main article section div td th center header footer nav aside form dialog menu fieldset details hgroup".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr blockquote pre figure figcaption address hr summary search".split())
ENDS_BEFORE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
LEFT_OUT = frozenset("nav header footer aside form script style noscript template iframe svg button select textarea head title menu dialog object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
NEVER_BY_NAME = frozenset("html body main article".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "signup share sharing social related recommended comment comments disqus replies widget pagination pager toolbar login search copyright".split()
)
# A class with one of these tells of a state, not of a part.
STATES = frozenset("has with without no is".split())

TAG = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^<>]*+)>|<[!?/][^>]*+>")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
DIGITS = re.compile(r"\d+")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# A longer path goes on from a digest of its beginning, so that deep nesting takes room in proportion to the page.
LONGEST_PATH = 600
# A paragraph counts fully for its container and by this share for the one around it.
OUTER_SHARE = 0.5
# Further text of which this share or more stands in links does not belong to the article.
LINKED_SHARE = 0.5


class Page:
    """Containers and text blocks of one page."""

    def __init__(self, source: str, forms_count: bool = False):
        self.parent, self.path, self.skip = [-1], [""], [False]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters inside links
        self._forms_count = forms_count
        self._parts: list[str] = []
        self._linked = self._links = 0
        self._node = 0
        self._muted = 0  # elements left out inside a block
        self._open: list[tuple[str, int, bool]] = []  # tag, container to return to, whether it mutes
        self._opened: Counter[str] = Counter()  # how many elements of each tag are open
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append((self._node, text, self._linked))
            self._parts, self._linked = [], 0

    def _text(self, raw: str) -> None:
        if self._muted:
            return
        text = html.unescape(raw) if "&" in raw else raw
        self._parts.append(text)
        if self._links:
            self._linked += len(text)

    def _close(self, depth: int) -> None:
        if any(tag in BLOCKS for tag, _, _ in self._open[depth:]):
            self._flush()
        for tag, node, mutes in reversed(self._open[depth:]):
            self._links -= tag == "a"
            self._opened[tag] -= 1
            self._muted -= mutes
            self._node = node
        del self._open[depth:]

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._flush()
            for depth in range(len(self._open) - 1, -1, -1) if self._opened["p"] else ():
                if self._open[depth][0] == "p":
                    self._close(depth)
                    break
                if self._open[depth][0] in CONTAINERS:
                    break
        if any(self._opened[t] for t in ENDS_BEFORE.get(tag, ())):
            for depth in range(len(self._open) - 1, -1, -1):
                if self._open[depth][0] in ENDS_WITHIN[tag]:
                    break
                if self._open[depth][0] in ENDS_BEFORE[tag]:
                    self._close(depth)
                    break
        if tag == "br":
            self._parts.append(" ")
        if tag in VOID:
            return
        names, left_out = _names(tag, attributes, tag == "header" and self._opened["article"] > 0)
        if tag == "form" and self._forms_count:
            left_out = False
        mutes = left_out and tag not in BLOCKS
        self._open.append((tag, self._node, mutes))
        self._links += tag == "a"
        self._opened[tag] += 1
        self._muted += mutes
        if tag in CONTAINERS or (left_out and not mutes):
            self.parent.append(self._node)
            outer = self.path[self._node]
            if len(outer) > LONGEST_PATH:
                outer = hashlib.md5(outer.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()
            self.path.append(f"{outer}>{tag}{names}")
            self.skip.append(self.skip[self._node] or left_out)
            self._node = len(self.parent) - 1

    def _read(self, source: str) -> None:
        at, last = 0, source.rfind(">") + 1  # no tag ends behind the last bracket
        while m := TAG.search(source, at, last):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if m[0] == "<!--":
                end = source.find("-->", at)
                at = len(source) if end < 0 else end + 3
                continue
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                if tag in BLOCKS:
                    self._flush()
                for depth in range(len(self._open) - 1, -1, -1) if self._opened[tag] else ():
                    if self._open[depth][0] == tag:
                        self._close(depth)
                        break
                continue
            attributes = m[3] or m[6] or ""
            if tag in RAW:
                end = re.compile(f"</{tag}[^>]*+>", re.IGNORECASE).search(source, at, last)
                at = len(source) if end is None else end.end()
                continue
            self._start(tag, attributes)
        if at < len(source):
            self._text(source[at:].partition("<!--")[0])

    def scores(self) -> list[float]:
        out = [0.0] * len(self.parent)
        for node, text, linked in self.blocks:
            if self.skip[node]:
                continue
            value = len(text) * max(0.0, 1 - linked / len(text))
            out[node] += value
            if node:
                out[self.parent[node]] += OUTER_SHARE * value
        return out

    def candidates(self) -> list[tuple[str, float]]:
        """All paths with a score, best first, with their share of the page's score."""
        by_path: dict[str, float] = {}
        for path, skip, score in zip(self.path, self.skip, self.scores()):
            if score > 0 and not skip:
                by_path[path] = by_path.get(path, 0.0) + score
        total = sum(by_path.values())
        best = sorted(by_path.items(), key=lambda x: (-x[1], x[0]))
        return [(path, score / total) for path, score in best]

    def _widened(self, path: str) -> set[int]:
        """The containers of that path, or what around each holds the rest of its article."""
        count = len(self.parent)
        whole = [i > 0 and self.path[i].rpartition(">")[2].split(".")[0] in ("article", "main") for i in range(count)]
        inside, around = [False] * count, [-1] * count  # around: nearest article or main
        for i in range(count):
            up = self.parent[i]
            inside[i] = self.path[i] == path or (i > 0 and inside[up])
            around[i] = i if whole[i] else around[up] if i else -1
        further, linked, others = [0] * count, [0] * count, [False] * count
        for node, text, links in self.blocks:
            if not self.skip[node] and not inside[node]:
                further[node] += len(text)
                linked[node] += links
                others[node] |= around[node] >= 0
        for i in range(count - 1, 0, -1):
            up = self.parent[i]
            further[up] += further[i]
            linked[up] += linked[i]
            others[up] |= others[i]
        tops = set()
        for i in range(count):
            if self.path[i] == path:
                top, up = (around[i], -1) if around[i] >= 0 else (i, self.parent[i])
                while up >= 0 and not others[up] and (not further[up] or linked[up] < LINKED_SHARE * further[up]):
                    top, up = (up if further[up] else top), self.parent[up]
                tops.add(top)
        return tops

    def text(self, path: str | None) -> str:
        """Blocks inside the widened containers of that path, else of the page's best one."""
        if path not in self.path or path is None:
            best = self.candidates()
            if not best:
                return ""
            path = best[0][0]
        tops = self._widened(path)
        inside = [False] * len(self.parent)
        for i in range(len(self.parent)):
            inside[i] = i in tops or (i > 0 and inside[self.parent[i]])
        return "\n\n".join(text for node, text, _ in self.blocks if inside[node] and not self.skip[node])


def _names(tag: str, attributes: str, heads_article: bool = False) -> tuple[str, bool]:
    """(generalised classes for the path, whether the element is boilerplate). What heads an article is part of it."""
    left_out = tag in LEFT_OUT and not heads_article
    if not attributes:
        return "", left_out
    found = {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(attributes)}
    classes = found.get("class", "").split()
    if tag not in NEVER_BY_NAME:
        named = [[p.lower() for p in NAME_PART.findall(c)] for c in [*classes, found.get("id", "")]]
        words = {w for parts in named if parts and not STATES & set(parts) for w in (parts[0], parts[-1])}
        style = found.get("style", "").replace(" ", "").lower()
        left_out |= bool(words & BOILERPLATE - ({"header"} if heads_article else set())) or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style
    return "".join(sorted({"." + DIGITS.sub("#", c.lower()) for c in classes})), left_out


def read_page(source: str) -> Page:
    page = Page(source)
    if not page.candidates() and "<form" in source.lower():  # some pages stand in one form as a whole
        page = Page(source, forms_count=True)
    return page


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        added: dict[tuple[str, str], list[float]] = {}
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            for path, share in read_page(source).candidates() if source else ():
                vote = added.setdefault((host, path), [0.0, 0])
                vote[0] += share
                vote[1] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in added]), pa.array([p for _, p in added]), pa.array([round(v[0] * 1e6) for v in added.values()], pa.int64())],
            schema=pa.schema([("host", pa.string()), ("path", pa.string()), ("votes", pa.int64())]),
        )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [read_page(s).text(p) if s else "" for s, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.string())], names=["row", "main"])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the container path that most of a host's pages vote for."""
    asked = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    votes = asked.mapInArrow(_votes, "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("against"), "path")).alias("best")).select("host", F.col("best.path").alias("path"))


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(row, main) per page: ``row`` holds the other columns, ``main`` the main text."""
    paths = kept(host_paths(pages, url_col, html_col), "host-paths")
    others = [F.col(f"`{c}`") for c in pages.columns if c != html_col]
    asked = pages.select(F.struct(*others).alias("row"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    joined = asked.join(paths, "host", "left").select("row", "html", "path")
    schema = StructType([joined.schema["row"]]).add("main", "string")
    return joined.mapInArrow(_extract, schema)
