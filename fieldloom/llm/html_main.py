"""Main text of web pages by consensus of each host's pages.

Every page is parsed and its containers are scored: text outside links, times a factor for what the element says it is. A page votes
for the path of its best container: tags and classes from the body down, digits generalised. Votes are summed per host and path in
Spark, and each page is then read again by its host's winning path; where a page has no such container, or only a small one beside
its own best, its own best is taken.

Defined results: null html is empty, with an empty text; a null url or one without ``://`` has the empty host; repeated rows give equal
texts; equal votes go to the higher score, then to the first path in order; an empty table gives an empty table; pages of any length
are read whole, in time and memory proportional to their length however deep or broken they are; other columns are ignored.

An element is left out by its tag or role, or by a class or id word of page furniture; words that an article's own headings and paragraphs may
carry too (``AMBIGUOUS``) count on containers only.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import staged

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_CUT_TAG = re.compile(r"<[!/]?[a-zA-Z][^>]*\Z")

# Elements of HTML by kind, and class words of page furniture.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp".split())
FURNITURE = set("head script style noscript template iframe svg canvas select button form input textarea nav header footer aside menu dialog object embed video audio".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = set("article main section div td body".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSABLE = set().union({"p"}, *CLOSED_BY.values())
SCOPES = set("table ul ol dl article section div body td".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form dialog alert".split())
FURNITURE_WORDS = set(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent notice notices notification popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget footer header masthead comment comments reply replies disqus share sharing social "
    "related recommended newsletter subscribe signup login search pagination pager toolbar copyright legal disclaimer".split()
)
AMBIGUOUS = set("banner copyright disclaimer footer header legal menu notice notices promotion related search share social widget".split())
TEXT_TAGS = set("p h1 h2 h3 h4 h5 h6 li blockquote pre dt dd figcaption caption th".split()) | INLINE
MAIN_WORDS = set("article content post entry main story body text".split())
WEIGHT = {"article": 1.5, "main": 1.3, "body": 0.6}
#: A container of the winning path counts if it has this share of the page's own best text.
SHARE = 0.5


class Node:
    __slots__ = ("tag", "part", "trail", "parent", "near", "children", "furniture", "named", "has_main", "text", "linked")

    def __init__(self, tag: str, parent: Node | None, attributes: str):
        self.tag, self.parent, self.children, self.has_main = tag, parent, [], False
        #: The nearest element, this one or above, that may be closed by another one or ends its reach.
        self.near = self if parent is None or tag in SCOPES or tag in CLOSABLE else parent.near
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        classes = sorted({re.sub(r"\d+", "N", c) for c in found.get("class", "").split()})
        self.part = ".".join([tag, *classes])
        self.trail = trail_of(self.part, parent.trail if parent else 0)
        words = {w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}").lower()) if w}
        self.named = bool(words & MAIN_WORDS) or found.get("role") == "main"
        told = words & FURNITURE_WORDS
        if tag in TEXT_TAGS:
            told -= AMBIGUOUS
        self.furniture = 2 if tag in FURNITURE or found.get("role") in FURNITURE_ROLES else 1 if told and tag not in ("html", "body") else 0
        self.text = self.linked = 0

    @property
    def path(self) -> str:
        parts, node = [], self
        while node:
            parts.append(node.part)
            node = node.parent
        return "/".join(reversed(parts))


def trail_of(path: str, trail: int = 0) -> int:
    """A 64-bit value of a path, or of a path's next parts after those that ``trail`` stands for."""
    for part in path.split("/"):
        trail = hash((trail, part))
    return trail


def parse(page: str) -> Node:
    """A tree of elements and strings. Open paragraphs and items are closed where HTML closes them."""
    root = node = Node("html", None, "")
    opened: Counter[str] = Counter()
    at, last = 0, page.rfind(">")

    def up_to(target: Node) -> Node:
        above = node
        while above is not target:
            opened[above.tag] -= 1
            above = above.parent
        return target

    while True:
        start = page.find("<", at)
        if start < 0 or start > last and not page.startswith("<!--", start):
            node.children.append(_CUT_TAG.sub("", page[at:]))
            return root
        m = _TAG.match(page, start)
        if not m:
            node.children.append(page[at : start + 1])
            at = start + 1
            continue
        if start > at:
            node.children.append(page[at:start])
        at = m.end()
        closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if closing:
            if opened[name] > 0:
                up = node
                while up.tag != name:
                    up = up.parent
                node = up_to(up.parent)
            continue
        if name == "html":
            continue
        shut = CLOSED_BY.get(name) or (() if name in INLINE or name in VOID - {"hr"} else {"p"})
        up = node.near if any(opened[t] > 0 for t in shut) else root
        while up is not root:
            if up.tag in shut:
                node = up_to(up.parent)
                if name != "tr":
                    break
            elif up.tag in SCOPES:
                break
            up = up.parent.near
        child = Node(name, node, rest)
        node.children.append(child)
        if name in VOID or rest.endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if name in ("article", "main"):
            up = node
            while up and not up.has_main:
                up.has_main = True
                up = up.parent
        opened[name] += 1
        node = child


def skipped(node: Node) -> bool:
    return node.furniture == 2 or node.furniture == 1 and not node.has_main


def measure(node: Node, linked: bool = False) -> None:
    """Sets each node's text length outside furniture, and how much of it is in links."""
    stack = [(node, linked, False)]
    while stack:
        node, linked, done = stack.pop()
        children = [c for c in node.children if not isinstance(c, str) and not skipped(c)]
        if not done:
            stack.append((node, linked, True))
            stack += [(c, linked or c.tag == "a", False) for c in children]
            continue
        own = sum(len(c) - c.count(" ") for c in node.children if isinstance(c, str) and not c.isspace())
        node.text = own + sum(c.text for c in children)
        node.linked = (own if linked else 0) + sum(c.linked for c in children)


def containers(root: Node) -> list[tuple[float, Node]]:
    """Containers outside furniture with their scores, in page order."""
    measure(root)
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in CONTAINERS or node is root:
            weight = WEIGHT.get(node.tag) or (1.3 if node.named else 0.5 if node is root else 1.0)
            out.append((weight * max(0, node.text - 2 * node.linked), node))
        stack += [c for c in reversed(node.children) if not isinstance(c, str) and not skipped(c)]
    return out


def text_in(node: Node) -> str:
    """Blocks in page order, white space made one space."""
    parts: list[str] = []
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x is node or not skipped(x):
            inline = x.tag in INLINE
            if not inline:
                parts.append("\n")
                stack.append("\n")
            stack.extend(reversed(x.children))
    return " ".join(html.unescape("".join(parts)).split())


def best(found: list[tuple[float, Node]]) -> tuple[float, Node]:
    return max(found, key=lambda x: x[0])


def extract(page: str, path: str | None) -> str:
    found = containers(parse(page))
    own = best(found)
    trail = trail_of(path) if path is not None else None
    # Equal paths are equally deep, so none of these stands in another.
    held = [node for score, node in found if score > 0 and node.trail == trail]
    if not held or sum(n.text for n in held) < SHARE * own[1].text:
        held = [own[1]]
    return " ".join(filter(None, map(text_in, held)))


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path, votes: each host's winning container path."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = [best(containers(parse(p))) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n.path for _, n in chosen], pa.string()), pa.array([s for s, _ in chosen], pa.float64())], ["host", "path", "score"])

    rows = pages.filter("html is not null").select(host_of(F.col("url")).alias("host"), "html")
    votes = rows.mapInArrow(vote, "host string, path string, score double").filter("score > 0").groupBy("host", "path")
    counted = votes.agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    first = F.struct(-F.col("votes"), -F.col("score"), "path")
    return counted.groupBy("host").agg(F.min_by(F.struct("path", "votes"), first).alias("won")).select("host", "won.path", "won.votes")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p, path) for p, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    # Written first, so that Spark knows the true size: hosts are broadcast only below its threshold, else joined by shuffle.
    paths = staged(host_paths(pages), "host-paths").select("host", "path")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    return rows.join(paths, "host", "left").select("page_id", "url", "html", "path").mapInArrow(read, "page_id long, url string, text string")
