"""Main text of web pages by composite text density.

A page is read into a tree by a scan over its tags (with the usual implied ends). Every node has characters, link characters, tags and link
tags; its composite density is characters per tag, damped by the share and number of links. The densities of a node's children are
added up; the article is the element of the greatest sum or the article or main around it, without parts that are mostly links; the least
density on the path from the first up to the body is the threshold by which further parts outside the article count as content.

Defined cases: null and empty pages give ''; pages cut off anywhere are read as far as they go, a tag cut off or with an open quote gives
no text; parts with a class like "sidebar" are no article, and with one like "related-work" only if their density says so; character references are decoded, unknown
ones stay; pages without any block element give their text as one block; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names from the HTML standard, and words that name parts of a page that aren't its article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style noscript template iframe svg math canvas object embed nav header footer aside form button select option textarea input dialog menu title noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html tbody td tfoot th thead tr li dd dt legend summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li ul ol menu dt dd dl tr td th table option select".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
SCOPES = frozenset("table td th".split())
CROSSING = frozenset("table tr tbody body".split())  # end tags that close cells, too
UNLIKELY = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal newsletter subscribe signup login nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar side aside rail widget footer header masthead topbar comment comments commentlist replies reply disqus respond share sharing social "
    "related recommended pagination pager skip toolbar".split()
)
#: Words that say where or how a part stands, not what it is.
NEUTRAL = frozenset(
    "area bar block body bottom box button buttons card cards col column container content count desktop fixed form global google group holder icons inner item items js left "
    "link links list main message mobile outer overlay page panel policy post posts articles stories primary reader reader's right row secondary section site slot small sticky "
    "text thread title top ui unit user wrap wrapper".split()
)
UNLIKELY_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|!--|!\[CDATA\[|[!?])")
_STOP = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"([^\s\"'/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z']+|[A-Z]+(?![a-z])|[^\W\d_]+")
_SPACE = re.compile(r"\s+")
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for name in RAW}


class Node:
    __slots__ = ("children", "chars", "density", "doubt", "item", "link_chars", "link_tags", "name", "near", "out", "sum", "tags", "titles", "up")

    def __init__(self, name: str, up: Node | None, out: bool = False, doubt: bool = False):
        self.name, self.up, self.out, self.doubt = name, up, out, doubt
        self.near: Node = self if name in BLOCK or up is None else up.near  # the innermost block that it is or stands in
        self.item: Node | None = self if name in ITEMS else up.item if up is not None else None
        self.children: list[Node | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = self.titles = 0
        self.density = self.sum = 0.0


def _unlikely(name: str, attributes: str) -> tuple[bool, bool]:
    """(whether an element is no part of an article by its name or attributes, whether a word of its class or id only hints at that).

    A class or id of unlikely and neutral words decides; one that joins an unlikely word to others is a hint for the densities to confirm.
    """
    if name in DROPPED:
        return True, False
    if not attributes or name in ("body", "html", "article", "main"):
        return False, False
    hint = False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key = key.lower()
        if key not in ("class", "id", "role", "hidden", "aria-hidden"):
            continue
        value = _html.unescape(values[0] or values[1] or values[2])
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in UNLIKELY_ROLES:
            return True, False
        if key in ("class", "id"):
            for word in value.split():
                parts = {x.lower() for x in _NAME_PART.findall(word)}
                if parts & UNLIKELY:
                    if parts <= UNLIKELY | NEUTRAL:
                        return True, False
                    hint = True
    return False, hint


class _Quotes:
    """Where tags end. What a page lacks from some place on is looked for once, so a scan of any page is linear."""

    def __init__(self, page: str):
        self.page, self.none = page, {}

    def find(self, what: str, at: int) -> int:
        if at >= self.none.get(what, len(self.page) + 1):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none[what] = at
        return found

    def end(self, at: int) -> tuple[int, int]:
        """(end of the attributes, place after the tag) of a tag whose attributes begin at a place.

        A quote that isn't closed, or is closed by the quote that opens a later value, ends with the next >; a tag that isn't, with the page.
        """
        while True:
            m = _STOP.search(self.page, at)
            if not m:
                return len(self.page), len(self.page)
            if not m[1]:
                return m.start(), m.end()
            close = self.find(m[1], m.end())
            end = self.find(">", m.end())
            if close < 0 or 0 <= end < close and self.page[close - 1] == "=":
                return (end, end + 1) if end >= 0 else (len(self.page), len(self.page))
            at = close + 1


def parse(page: str) -> Node:
    """The tree of a page, in time linear in its length."""
    root = node = Node("html", None)
    at, size, quotes = 0, len(page), _Quotes(page)
    total: Counter[str] = Counter()  # open elements by name
    scopes: list[tuple[Node, Counter[str]]] = [(root, Counter())]  # the same since each open table or cell

    def leave(target: Node) -> Node:
        """Closes everything inside target and target itself."""
        at = node
        while True:
            if at.name in SCOPES:
                scopes.pop()
            scopes[-1][1][at.name] -= 1
            total[at.name] -= 1
            if at is target:
                return at.up
            at = at.up

    while at < size:
        m = _OPEN.search(page, at)
        begin = m.start() if m else size
        if begin > at:
            node.children.append(page[at:begin])
        if not m:
            break
        if m[2] is None:
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            end = quotes.find(close, m.end())
            at = end + len(close) if end >= 0 else size
            continue
        name = m[2].lower()
        stop, at = quotes.end(m.end())
        if m[1]:
            inside, open_ = scopes[-1]
            if name in CROSSING and total[name] or name in ("td", "th") and inside.name == name or name not in SCOPES and open_[name]:
                up = node
                while up.name != name:
                    up = up.up
                if up.up is not None:
                    node = leave(up)
            continue
        attributes = page[m.end() : stop]
        if name == "html":
            continue
        if name in CLOSES_P and node.near.name == "p":
            node = leave(node.near)
        if name in HEADINGS and node.name in HEADINGS:
            node = leave(node)
        if name in ("tr", "td", "th") and scopes[-1][0].name in ("td", "th"):
            node = leave(scopes[-1][0])
        if name in ENDS:
            while node.item is not None and node.item.name in ENDS[name]:
                node = leave(node.item)
        if name == "body":  # the head ends
            while node.up is not None:
                node = leave(node)
        out, doubt = (True, False) if node.out else _unlikely(name, attributes)
        new = Node(name, node, out, doubt)
        node.children.append(new)
        if name in RAW:
            end = _END[name].search(page, at)
            stop = end.start() if end else size
            new.children.append(page[at:stop])
            at = end.end() if end else size
        elif name not in VOID and not attributes.endswith("/") or name in BLOCK - {"hr"}:
            node = new
            total[name] += 1
            scopes[-1][1][name] += 1
            if name in SCOPES:
                scopes.append((new, Counter()))
    return root


def _measure(root: Node) -> None:
    """Counts, densities and sums of every node, children first. Parts that are out count as nothing."""
    order, stack = [], [(root, False)]
    while stack:
        node, link = stack.pop()
        node.chars = node.link_chars = node.tags = node.link_tags = node.titles = 0
        node.density = node.sum = 0.0
        order.append((node, link))
        stack.extend((c, link or c.name == "a") for c in node.children if isinstance(c, Node) and not c.out)
    for node, link in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                n = len(_SPACE.sub(" ", c).strip())
                node.chars += n
                node.link_chars += n * link
            elif not c.out:
                node.chars, node.link_chars = node.chars + c.chars, node.link_chars + c.link_chars
                node.titles += c.titles + (c.name == "h1")
                node.tags, node.link_tags = node.tags + c.tags + 1, node.link_tags + c.link_tags + (c.name == "a")
    body_chars, body_links = max(1, root.chars), root.link_chars
    for node, _ in reversed(order):
        c, t = node.chars, max(1, node.tags)
        if c:
            lc, lt = max(1, node.link_chars), max(1, node.link_tags)
            inside = math.log(lc / max(1, c - node.link_chars) * c + body_links / body_chars * c + math.e)
            node.density = c / t * max(0.0, math.log(c / lc * t / lt + 1e-9) / math.log(inside)) if inside > 1 else c / t
        node.sum = sum(x.density for x in node.children if isinstance(x, Node) and not x.out)


def _blocks(node: Node, chosen: set[int] | None, out: list[str]) -> None:
    """The texts of the block elements below node, in order; with chosen, only inside chosen nodes."""
    held: list[str] = []

    def end():
        text = _SPACE.sub(" ", _html.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append(text)

    stack: list[tuple[Node | str | None, bool]] = [(node, chosen is None)]
    while stack:
        x, on = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            if on:
                held.append(x)
        elif not x.out:
            on = on or chosen is not None and id(x) in chosen
            if x.name == "br":
                held.append(" ")
                continue
            block = x.name in BLOCK
            if block:
                end()
                stack.append((None, on))
            stack.extend((c, on) for c in reversed(x.children))
    end()


def _confirm(root: Node) -> bool:
    """Takes out the doubtful parts that are mostly links, or that are thinner than half the page and hold no title; says whether any went."""
    went, stack = False, [root]
    while stack:
        node = stack.pop()
        if node.doubt and (2 * node.link_chars >= node.chars or 2 * node.density < root.density and not node.titles):
            node.out = went = True
        elif not node.out:
            stack.extend(c for c in node.children if isinstance(c, Node) and not c.out)
    return went


def _text_part(node: Node) -> bool:
    """Whether a part beside dense text belongs to it: a heading, or text that is not mostly links."""
    return node.name in HEADINGS or 2 * node.link_chars < node.chars


def _around(best: Node) -> Node:
    """The article or main around the densest element; without one, the furthest element that holds only text parts beside it."""
    node = best
    while node is not None and node.name not in ("article", "main", "body"):
        node = node.up
    if node is not None and node.name != "body":
        return node
    node = best
    while node.up is not None and node.up.up is not None and node.up.name != "body":
        beside = [c for c in node.up.children if isinstance(c, Node) and not c.out and c is not node and c.chars]
        if not all(_text_part(c) for c in beside):
            break
        node = node.up
    return node


def extract(page: str | None) -> str:
    """The main text of a page, one line per block."""
    if not page:
        return ""
    root = parse(page)
    _measure(root)
    if _confirm(root):
        _measure(root)
    best, stack = root, [root]
    while stack:
        node = stack.pop()
        if node.sum > best.sum:
            best = node
        stack.extend(c for c in node.children if isinstance(c, Node) and not c.out)
    if best.up is not None and best.name in ("p", "li", "ul", "ol", "table", "tr", "tbody", "dl", "blockquote", *HEADINGS):
        best = best.up  # a paragraph's own parts are no article
    path, node = [], best
    while node is not None and node.name != "body" and node.up is not None:
        path.append(node)
        node = node.up
    threshold = min([n.density for n in path if n.density > 0], default=0.0)
    around = _around(best) if best.up is not None and best.name != "body" else best
    node = best
    while node is not around:
        for c in node.up.children:
            if isinstance(c, Node) and c is not node and c.chars and not _text_part(c):
                c.out = True
        node = node.up
    chosen = {id(around)}
    # Beside the path, whole parts as dense as the path and with a sum of their own belong to the article too.
    for n in path[path.index(around) if around in path else 0 :]:
        chosen.update(id(c) for c in n.up.children if isinstance(c, Node) and not c.out and c is not n and threshold > 0 and c.density >= threshold and (c.sum >= threshold or c.name in ("p", *HEADINGS)))
    out: list[str] = []
    _blocks(root, chosen, out)
    return "\n".join(out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = [extract(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
