"""Main text of web pages by composite text density.

Every node of the page's tree gets its characters per tag, lowered the more of
its characters and tags are links.  A node's density sum adds up its children's
densities; the largest sum marks the part of the page where dense paragraphs
stand together.  The smallest density on the way from there to the body is the
threshold that a neighbouring branch must reach to count as content too.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)"
    r"|<(?P<end_>/?)(?P<tag_>[a-zA-Z][^\s/>]*)(?P<attrs_>[^>]*)(?:>|\Z)", re.S  # a quote that never ends: up to the next >
)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that are never article text.
DROPPED = frozenset(
    "nav header footer aside form script style template noscript iframe object embed svg canvas audio video button "
    "select option textarea input label fieldset dialog menu head title".split()
)
#: Words that mark what is not article text, as the first or the last word of a class, id or role.
NOISE = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promoted "
    "promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars header footer masthead "
    "comment comments commentlist respond reply replies disqus cookie cookies consent gdpr notice notices popup "
    "modal newsletter subscribe subscription signup login sharing social pagination pager contentinfo complementary search".split()
)
#: Those that mark discussions, which may be longer than the article.
TALK = frozenset("comment comments commentlist respond reply replies disqus".split())
#: Words that turn a mark into a property of a wrapper, as in page-with-header.
ABOUT = frozenset("has with no without".split())
#: Before "header" these make the article's own heading.
HEADED = frozenset("article content entry post section story".split())
#: Elements that hold whole pages or articles; only one of these as a whole class word marks them as noise.
WHOLE = frozenset("html body article main".split())
WHOLE_NOISE = frozenset("comment reply ad advert advertisement sponsored promo teaser".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 "
    "h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul".split()
)
#: Start tags that end an open element: the open ones they end, and where the search for them stops.
ENDS = {
    **dict.fromkeys(BLOCKS - {"html", "body"}, (frozenset("p"), frozenset("button table td th".split()))),
    "li": (frozenset(["li", "p"]), frozenset("ul ol menu".split())),
    "dt": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd", "p"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])), "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tr": (frozenset(["td", "th", "tr"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}


class Node:
    __slots__ = ("tag", "noise", "parent", "items", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, noise: int = 0):
        self.tag, self.parent, self.noise = tag, parent, noise
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


#: Words of a class, id or role: parted by punctuation and by the humps of camel case.
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z0-9]+|[0-9]+")


def _marks(value: str) -> set[str]:
    """First and last word of every name in a class, id or role, and the whole name."""
    marks = set()
    for name in value.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if words and ABOUT.isdisjoint(words):
            marks |= {name.lower(), words[0]}
            if words[-1] != "header" or words[0] not in HEADED:
                marks.add(words[-1])
    return marks


#: How sure it is that an element is noise: a marked one or a form may yet be a wrapper of the article.
MARKED, TALKED, SURE = 1, 2, 3


def _noise(tag: str, attrs: str) -> int:
    level = 0 if tag not in DROPPED else MARKED if tag == "form" else SURE
    if not attrs or level == SURE:
        return level
    for name, a, b, c in _ATTR.findall(attrs):
        name, raw = name.lower(), a or b or c
        value = raw.lower()
        if tag in WHOLE:
            if name == "class" and not WHOLE_NOISE.isdisjoint(value.split()):
                return SURE
        elif name in ("class", "id", "role"):
            marks = _marks(raw)
            if not TALK.isdisjoint(marks):
                level = TALKED
            elif not NOISE.isdisjoint(marks):
                level = max(level, MARKED)
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return SURE
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return SURE
    return level


def _settle(top: Node) -> None:
    """Clear the mark of wrappers of the article.

    Outside of articles, a marked element that holds an article or main element is one
    (a discussion only if it holds all of the page's), and so is anywhere a
    marked element, but no discussion, with over half of the page's characters outside of links.
    """
    seen: list[tuple[Node, bool]] = []
    free: dict[Node, int] = {}
    held: dict[Node, int] = {}
    stack = [(top, False, False)]
    while stack:
        node, linked, inside = stack.pop()
        seen.append((node, inside))
        linked, inside = linked or node.tag == "a", inside or node.tag == "article"
        free[node], held[node] = 0, int(node.tag in ("article", "main"))
        for x in node.items:
            if isinstance(x, Node):
                if x.noise != SURE:
                    stack.append((x, linked, inside))
            elif not linked:
                free[node] += sum(map(len, x.split()))
    for node, _ in reversed(seen):
        if node.parent is not None:
            free[node.parent] += free[node]
            held[node.parent] += held[node]
    for node, inside in seen:
        if not node.noise:
            continue
        holds = held[node] if node.noise == MARKED else held[node] and held[node] == held[top]
        if holds and not inside or node.noise == MARKED and 2 * free[node] > free[top]:
            node.noise = 0


_RAW_END = {tag: re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I) for tag in RAW}


class Open:
    """The innermost open element, and how many elements of each tag are open around it.

    The counts end a search for an open element when there is none left to find.
    """

    def __init__(self, top: Node):
        self.top = self.at = top
        self.count: dict[str, int] = {}

    def enter(self, node: Node) -> None:
        self.at = node
        self.count[node.tag] = self.count.get(node.tag, 0) + 1

    def leave_to(self, node: Node) -> None:
        while self.at is not node:
            self.count[self.at.tag] -= 1
            self.at = self.at.parent

    def make_room(self, tag: str) -> None:
        """Leave the open elements that a start tag ends."""
        closes, stops = ENDS[tag]
        node, found, left = self.at, None, sum(self.count.get(t, 0) for t in closes)
        while left and node is not self.top and node.tag not in stops:
            if node.tag in closes:
                found, left = node, left - 1
            elif node.tag in BLOCKS and node.tag not in ("div", "address"):
                break
            node = node.parent
        if found is not None:
            self.leave_to(found.parent)

    def end(self, tag: str) -> None:
        """Leave the element of an end tag, unless a block stands between for an inline tag."""
        if not self.count.get(tag):
            return
        node = self.at
        while node.tag != tag:
            if node.tag in BLOCKS and tag not in BLOCKS:
                return
            node = node.parent
        self.leave_to(node.parent)


def parse(page: str) -> Node:
    """The page's element tree; unclosed, crossed and cut-off tags are taken as browsers take them.

    A tag with a quote that never ends goes up to the next >.
    """
    top = Node("html", None)
    tree, pos, search, marked = Open(top), 0, _TOKEN.search, False
    while m := search(page, pos):
        if m.start() > pos:
            tree.at.items.append(page[pos : m.start()])
        pos = m.end()
        end, tag, attrs = m.group("end", "tag", "attrs")
        if tag is None:
            end, tag, attrs = m.group("end_", "tag_", "attrs_")
        if tag is None:  # a comment, a declaration, or text in CDATA
            if m[0].startswith("<![CDATA["):
                tree.at.items.append(m[0][9:-3].replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if end:
            tree.end(tag)
        elif tag in VOID:
            if tag in ("br", "hr", "wbr"):
                tree.at.items.append(Node(tag, tree.at))
        elif tag not in ("html", "body"):
            if tag in ENDS:
                tree.make_room(tag)
            node = Node(tag, tree.at, _noise(tag, attrs))
            marked = marked or MARKED <= node.noise < SURE
            tree.at.items.append(node)
            if tag in RAW:
                close = _RAW_END[tag].search(page, pos)
                node.items.append(page[pos : close.start() if close else len(page)])
                pos = close.end() if close else len(page)
            else:
                tree.enter(node)
    if pos < len(page):
        tree.at.items.append(page[pos:])
    if marked:
        _settle(top)
    return top


def _density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    if not chars:
        return 0.0
    tags, lc, lt = max(1, tags), max(1, link_chars), max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + body_share * chars + math.e)
    return chars / tags * math.log(max(1.0, chars / lc * tags / lt)) / max(1e-9, math.log(base + 1))


def measure(top: Node) -> list[Node]:
    """Fill the counts and densities of all nodes that are not noise; returns them, parents first.

    density = C/T * log(C/LC * T/LT) to the base log(C/(C-LC)*LC + LCb/Cb*C + e), with C
    characters, T tags, LC and LT those of links, b the whole page; counts of 0 in a
    denominator are 1, and 1 is added to the base, which is 1 for a page without links.
    """
    nodes, stack = [], [(top, False)]
    while stack:
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        nodes.append(node)
        for x in node.items:
            if isinstance(x, str):
                n = sum(map(len, x.split()))
                node.chars += n
                if linked:
                    node.link_chars += n
            elif not x.noise:
                stack.append((x, linked))
    for node in reversed(nodes):
        up = node.parent
        if up is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags + (node.tag == "a")
    body_share = top.link_chars / max(1, top.chars)
    for node in nodes:
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, body_share)
    for node in nodes:
        if node.parent is not None:
            node.parent.total += node.density
    return nodes


def main_nodes(top: Node) -> list[Node | str]:
    """The branches that hold the article, in page order.

    From the node with the largest density sum the search goes up to an enclosing
    article or main element, if there is one: that is the branch, and with an article
    the articles beside it that are at least half as dense, as a story in parts has them.
    Without one it goes up to the last parent that has other branches which reach the threshold;
    of that parent all from the first to the last branch that reaches it are taken, the short
    ones between them too.  Text that stands directly in a parent is a branch like any other.
    """
    nodes = [n for n in measure(top) if n.chars]
    if not nodes:
        return []
    best = max(nodes, key=lambda n: n.total) if any(n.total > 0 for n in nodes) else top
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    enclosing = next((n for n in path if n.tag in ("article", "main")), None)
    if enclosing is None:
        enclosing = max((n for n in nodes if n.tag in ("article", "main")), key=lambda n: n.chars, default=None)
    if enclosing is not None:
        if enclosing.tag == "main":
            return [enclosing]
        beside = [x for x in enclosing.parent.items if isinstance(x, Node) and x.tag == "article" and not x.noise]
        return [x for x in beside if x is enclosing or x.chars and x.density >= enclosing.density / 2]
    threshold, share = min(n.density for n in path), top.link_chars / max(1, top.chars)
    chosen: list[Node | str] = [best]
    for child, node in zip(path, path[1:]):
        dense = []
        for i, x in enumerate(node.items):
            if isinstance(x, str):
                n = sum(map(len, x.split()))
                if n and _density(n, 0, 0, 0, share) >= threshold:
                    dense.append(i)
            elif x is child or not x.noise and x.chars and x.tag in BLOCKS and x.density >= threshold:
                dense.append(i)
        if len(dense) > 1:
            chosen = node.items[dense[0] : dense[-1] + 1]
    return chosen


def text_of(branches: list[Node | str]) -> str:
    """Text of branches: one line per block, white space in a block as one space."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = "".join(line)
        line.clear()
        if text := " ".join((html.unescape(text) if "&" in text else text).split()):
            blocks.append(text)

    stack: list[Node | str | None] = list(reversed(branches))
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif not x.noise:
            block = x.tag in BLOCKS
            if block:
                flush()
                stack.append(None)
            elif x.tag == "br":
                line.append(" ")
            stack.extend(reversed(x.items))
    flush()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    """Main text of one page; empty for null, empty and text-free pages."""
    if not page:
        return ""
    return text_of(main_nodes(parse(page)))


def extract(page: Column) -> Column:
    """Main text of a column of whole pages."""

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages], dtype=object)

    return texts(page)


def with_main_text(pages: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """All columns of ``pages`` and ``out``; a column of that name is replaced.

    Every row on its own: a null or empty page gives the empty text, repeated
    rows give equal texts, an empty table gives no rows.
    """
    return pages.withColumn(out, extract(F.col(page)))
