"""Main text of web pages by composite text density.

A page is read into a tree in one pass. Every node has its characters C, those inside links LC, its tags T and link tags
LT. Its density is the link-adjusted characters per tag::

    C / T * ln(C / LC * T / LT) / ln(b)    with    b = max(e, ln(C / (C - LC) * LC + LC_page / C_page * C + e))

where every divisor is at least 1. The base is at least e, so pages with few links do not favour short nodes. The density
sum of a block is the sum of the densities of the blocks below it, its own lines of text counting as one of them. The
block with the largest sum is the article's core; the least density on the way from it to the body is the threshold.

The densities decide what else is taken: a part beside that way whose density reaches the threshold and whose characters
are not mostly links is taken, with all that stands between it and the core, and a heading before them. Groups of links
below the threshold are left out wherever they stand. No element's name makes a part an article.

Before that, elements are left out that are boilerplate by tag, by role, by the attribute ``hidden`` or a style of
``display: none``, or by a class or id that names them: all parts of one of its words are in DROP_WORDS or NEUTRAL
(``sidebar``, ``site-footer``, not ``has-sidebar`` or ``related-work``). A wrapper of WRAPPER_CHARS characters or more that
holds over nine tenths of the page's text is no boilerplate, unless it is named for comments; what it holds is judged.

Text is never capped. Character references are decoded by the standard table, as browsers do. White space inside a block
becomes one space; blocks are joined by an empty line. ``<br>`` is white space.

Scale: a narrow pass, one page at a time, in time linear in the page: open elements are kept by name, so no end tag
searches the others. Edge cases: null or empty html, and pages with markup alone, give an empty text; text without any
markup is its own article; unclosed and misnested tags end where their parent does; quotes count only at the start of an
attribute's value; repeated rows are read each; columns other than page_id, url and html pass by, whatever their names.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.llm.words import lean_batches

#: Fixed values of HTML: elements without content, with raw text, and those that interrupt a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
GROUPS = frozenset("div section ul ol dl table center span p".split())
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot li dd dt option optgroup legend summary figcaption".split())
#: An opening tag ends the last open element of these names, unless one of the second names was opened since.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
#: What is never part of an article. WRAPPERS of these may hold a whole page.
DROP_TAGS = frozenset("nav header footer aside form script style noscript template iframe button select option textarea input svg math object canvas audio video dialog menu head title".split())
WRAPPERS = frozenset("header aside form dialog".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices disclaimer popup modal overlay newsletter subscribe subscription signup "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar aside widget widgets related recommended recommendations share sharing social comment comments commentlist disqus respond replies reply footer header masthead topbar toolbar login search".split()
)
#: Words beside them that say where or in what form the named element stands.
NEUTRAL = frozenset(
    "a all area article articles bar block body bottom box button buttons col column container content div entry first form global group header icons inner item items last layer left line link links list main message page panel "
    "post posts primary reader right row secondary section site slot story text thread top unit user wrap wrapper zone".split()
)
#: Of these, names of reader comments, which may be longer than the article.
TALK_WORDS = frozenset("comment comments commentlist disqus respond replies reply".split())
WRAPPER_CHARS = 250
_OPEN = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[A-Za-z])")
_NAME = re.compile(r"[^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?)")
_WORDS = re.compile(r"[A-Za-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element; ``kids`` holds elements and strings in page order."""

    __slots__ = ("tag", "kids", "drop", "soft", "chars", "link_chars", "tags", "link_tags", "heads", "line", "density", "blocks", "total")

    def __init__(self, tag: str, drop: bool = False, soft: bool = False) -> None:
        # soft: dropped by name alone, so a wrapper of the whole page may be taken back
        self.tag, self.drop, self.soft = tag, drop, soft
        self.kids: list[Node | str] = []
        self.chars = self.link_chars = self.tags = self.link_tags = self.heads = 0
        self.line = (0, 0, 0, 0)
        self.density = self.blocks = self.total = 0.0


def _names(value: str) -> set[str]:
    """The boilerplate words of the words of ``value`` that name nothing else."""
    found: set[str] = set()
    for word in value.split():
        parts = {x.lower() for x in _WORDS.findall(_CAMEL.sub(" ", word))}
        if all(x in DROP_WORDS or x in NEUTRAL for x in parts):
            found |= parts & DROP_WORDS
    return found


def _judged(tag: str, attributes: dict[str, str]) -> tuple[bool, bool]:
    """Whether an element is boilerplate, and whether it may yet be a wrapper of the page."""
    if tag in DROP_TAGS:
        return True, tag in WRAPPERS
    if not attributes or tag in ("body", "html"):
        return False, False
    if attributes.get("hidden", "until-found").lower() != "until-found" or _NO_DISPLAY.search(attributes.get("style", "")):
        return True, False
    named = _names(attributes.get("class", "")) | _names(attributes.get("id", ""))
    drop = bool(named) or attributes.get("role", "").strip().lower() in DROP_ROLES
    return drop, drop and TALK_WORDS.isdisjoint(named)


def _attributes(page: str, at: int) -> tuple[dict[str, str], int, bool]:
    """Attributes from ``at``, the place after the tag, and whether it closes itself; the first of a name counts."""
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        if m is None:  # the page ends inside the tag
            return found, len(page), False
        if m[1]:
            return found, m.end(), page[m.end() - 2] == "/" and m.end() - 2 >= at
        found.setdefault(m[2].lower(), m[3] or m[4] or m[5] or "")
        at = m.end()


class _Open:
    """The open elements, by place and by name."""

    def __init__(self, root: Node) -> None:
        self.stack, self.at, self.blocks = [root], defaultdict(list), []

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def close(self, place: int) -> None:
        for node in self.stack[place:]:
            self.at[node.tag].pop()
        while self.blocks and self.blocks[-1] >= place:
            self.blocks.pop()
        del self.stack[place:]

    def last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)


def parse(page: str) -> Node:
    """The page's tree; tolerant of unclosed, misnested and unknown tags."""
    root = Node("#page")
    open_, at, unclosed = _Open(root), 0, set()
    stack = open_.stack
    while True:
        m = _OPEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            stack[-1].kids.append(html_lib.unescape(text) if "&" in text else text)
        if not m:
            return root
        mark, at = m[0], m.end()
        if mark[1] in "!?":
            stop = "-->" if mark == "<!--" else "]]>" if mark == "<![CDATA[" else ">"
            end = page.find(stop, at - 2 if stop == "-->" else at)
            if mark == "<![CDATA[":
                stack[-1].kids.append(page[at : end if end >= 0 else len(page)])
            at = len(page) if end < 0 else max(end + len(stop), at)
            continue
        shut = mark[1] == "/"
        name = _NAME.match(page, at - 1)
        tag, at = name[0].lower(), name.end()
        if page[at : at + 1] == ">":
            attributes, at, alone = {}, at + 1, False
        else:
            attributes, at, alone = _attributes(page, at)
        if shut:
            place = open_.last(tag)
            # an inline end tag does not close the block around it
            if place and (tag in BLOCK or not open_.blocks or open_.blocks[-1] < place):
                open_.close(place)
            continue
        if tag in CLOSES_P:
            if open_.blocks and stack[open_.blocks[-1]].tag == "p":
                open_.close(open_.blocks[-1])
        elif tag in ENDS:
            own, stop = ENDS[tag]
            place = open_.last(*own)
            if place > open_.last(*stop):
                open_.close(place)
        node = Node(tag, *_judged(tag, attributes))
        stack[-1].kids.append(node)
        if tag in RAW:
            node.drop, node.soft = True, False
            end = None if tag in unclosed else re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
            else:
                unclosed.add(tag)
                if tag in ("script", "style", "textarea", "title"):
                    at = len(page)
        elif tag not in VOID and not alone:
            open_.push(node)


def _length(text: str) -> int:
    return len(" ".join(text.split()))


def _take_back(root: Node) -> None:
    """Undo the drop by name of wrappers that hold more than nine tenths of the page's text."""
    order: list[tuple[Node, Node | None]] = []
    todo: list[tuple[Node, Node | None]] = [(root, None)]
    while todo:
        node, up = todo.pop()
        order.append((node, up))
        todo.extend((k, node) for k in node.kids if isinstance(k, Node) and (k.soft or not k.drop))
    if not any(n.soft for n, _ in order):
        return
    size: dict[int, int] = defaultdict(int)
    for node, up in reversed(order):
        size[id(node)] += sum(_length(k) for k in node.kids if isinstance(k, str))
        if up is not None:
            size[id(up)] += size[id(node)]
    for node, _ in order:
        if node.soft and size[id(node)] >= WRAPPER_CHARS and size[id(node)] * 10 > size[id(root)] * 9:
            node.drop = False


def density(chars: int, link_chars: int, tags: int, link_tags: int, page_share: float) -> float:
    """Composite text density: characters per tag, lowered where links hold the characters."""
    if not chars:
        return 0.0
    tags, link_tags, plain = max(tags, 1), max(link_tags, 1), max(chars - link_chars, 1)
    base = math.log(chars / plain * link_chars + page_share * chars + math.e)
    inside = chars / max(link_chars, 1) * tags / link_tags
    return chars / tags * math.log(max(inside, 1.0)) / math.log(max(base, math.e))


def _measure(root: Node) -> None:
    """Counts, densities and density sums of every node, children first, without recursion."""
    order, todo = [], [(root, False)]
    while todo:
        node, linked = todo.pop()
        linked = linked or node.tag == "a"
        order.append((node, linked))
        todo.extend((k, linked) for k in node.kids if isinstance(k, Node) and not k.drop)
    for node, linked in reversed(order):
        lines = [0, 0, 0, 0]
        for k in node.kids:
            if isinstance(k, str):
                n = _length(k)
                node.chars += n
                node.link_chars += n if linked else 0
                lines[0] += n
                lines[1] += n if linked else 0
            elif not k.drop:
                node.chars += k.chars
                node.link_chars += k.link_chars
                node.tags += k.tags + 1
                node.link_tags += k.link_tags + (k.tag == "a")
                node.heads += k.heads
                if k.tag not in BLOCK:
                    own = (*k.line[:2], k.line[2] + 1, k.line[3] + (k.tag == "a"))
                    lines = [a + b for a, b in zip(lines, own, strict=True)]
        node.line = tuple(lines)
        if node.tag in HEADINGS:
            node.heads = node.chars
    share = root.link_chars / max(root.chars, 1)
    for node, _ in reversed(order):
        node.density = density(node.chars, node.link_chars, node.tags, node.link_tags, share)
        node.blocks = sum(k.density if k.tag in BLOCK else k.blocks for k in node.kids if isinstance(k, Node) and not k.drop)
        node.total = node.blocks + density(*node.line, share)


def _mostly_links(node: Node) -> bool:
    return node.link_chars * 2 > node.chars


def _content(kids: list[Node | str], core: int, threshold: float, share: float) -> tuple[int, int]:
    """First and last of ``kids`` that belong to the article with the one at ``core``."""

    def dense(k: Node | str) -> bool:
        if isinstance(k, str):
            n = _length(k)
            return n > 0 and density(n, 0, 1, 0, share) >= threshold
        return not k.drop and k.chars > 0 and k.density >= threshold and not _mostly_links(k)

    own = [i for i, k in enumerate(kids) if i == core or dense(k)]
    first, last = own[0], own[-1]
    for i in range(first - 1, -1, -1):
        k = kids[i]
        if isinstance(k, str) or k.drop or not k.chars:
            continue
        if _mostly_links(k):
            break
        if k.heads == k.chars:
            first = i
    return first, last


def _chosen(root: Node) -> Node:
    """The article's subtree: the largest density sum, widened along the way to the body by its threshold."""
    body = next((k for k in _walk(root) if k.tag == "body" and not k.drop), root)
    above: dict[int, Node | None] = {id(body): None}
    top, todo = body, [body]
    while todo:
        node = todo.pop()
        if (node.tag in BLOCK or node is body) and node.total > top.total:
            top = node
        for k in node.kids:
            if isinstance(k, Node) and not k.drop:
                above[id(k)] = node
                todo.append(k)
    way: list[Node] = []
    node: Node | None = top
    while node is not None:
        way.append(node)
        node = above[id(node)]
    threshold, share, chosen = min(n.density for n in way), root.link_chars / max(root.chars, 1), 0
    for k in range(1, len(way)):
        kids = way[k].kids
        core = next(i for i, x in enumerate(kids) if x is way[k - 1])
        first, last = _content(kids, core, threshold, share)
        way[k].kids = kids[first : last + 1]
        if first < core or last > core:
            chosen = k
    passed = {id(n) for n in way[: chosen + 1]}
    todo = [way[chosen]]
    while todo:
        node = todo.pop()
        for x in node.kids:
            if isinstance(x, Node) and not x.drop:
                if id(x) not in passed and x.tag in GROUPS and x.link_tags > 1 and x.density < threshold and _mostly_links(x):
                    x.drop = True
                else:
                    todo.append(x)
    return way[chosen]


def _walk(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))


def _blocks(root: Node) -> list[str]:
    """Text of each block in page order."""
    found, held = [], []

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            found.append(text)
        held.clear()

    todo: list[Node | str | None] = [root]
    while todo:
        node = todo.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            held.append(node)
        elif node.tag == "br":
            held.append(" ")
        elif not node.drop or node is root:
            block = node.tag in BLOCK
            if block:
                flush()
                todo.append(None)
            todo.extend(reversed(node.kids))
    flush()
    return found


def main_text(page: str | None) -> str:
    """The article's text; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    _take_back(root)
    _measure(root)
    return "\n\n".join(_blocks(_chosen(root)))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    lean_batches(pages.sparkSession)
    lean = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return lean.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
