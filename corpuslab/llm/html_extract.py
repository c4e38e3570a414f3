"""Operator 1: main text of HTML pages by minimum-cut labelling.

A page is read as a stream of tags; runs of text between block-level tags are blocks, each with
its place in the tree. A linear classifier gives each block log odds of being content, from the kind of
elements around it, words in their class, id and role, share of text in links, length and punctuation.
These become capacities to the two terminals. Neighbouring blocks are joined by
smoothness edges, the stronger the fewer steps lie between them in the tree, and blocks with one
parent by one more. The minimum cut labels all blocks of a page at once; it is found by
fixing blocks whose terminal outweighs all their edges, and by max-flow (Dinic) on what is left.

Menus, headers outside articles, footers, sidebars, notices, adverts, forms and reader comments get odds that no edge outweighs, unless
it is only a class name on an element that holds most of the page's text. Scripts, styles, titles and
comments of the markup aren't text.

White space (Unicode) inside a block becomes one space; character references are decoded once;
blocks are joined by two line feeds, in page order.

Defined cases: null, empty and blank html gives an empty text; cut-off pages are read as far as they
go, without an unfinished tag; unclosed and stray tags are repaired (a paragraph ends at the next block);
repeated pages are treated each on its own; an empty table gives an empty table; other columns pass through, one
named like the output is replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import by_bytes, texts_of

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*+)>", re.S)
_UNFINISHED = re.compile(r"<[a-zA-Z/!?][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_END = re.compile(r"[.!?…。？！][\"'”’»)]*\Z")

BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
                  "form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
                  "section summary table tbody tfoot thead tr ul caption colgroup noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag (or the page's end), and elements whose content stands in for what is shown.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
INSTEAD = frozenset("svg object canvas audio video template".split())
GAP = frozenset("br td th img svg math object canvas audio video".split())
#: Elements that never hold main text, and words in class, id and role that say so.
OFF_TAGS = frozenset("nav footer aside form menu dialog button select fieldset noscript search".split())
OFF_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adsense sponsor sponsored promo promotion promoted banner nav navigation navbar navi menu "
    "breadcrumb breadcrumbs sidebar sidebars aside footer header masthead cookie cookies consent gdpr notice notices notification popup modal overlay "
    "subscribe subscription newsletter signup login social share sharing related recommended recommendation recommendations comment "
    "comments commentlist respond replies disqus widget widgets pagination pager toolbar copyright disclaimer "
    "alert complementary contentinfo search form paywall teaser outbrain taboola".split())
ON_WORDS = frozenset("article content post entry story main body text".split())
#: A paragraph that is open outside of these stays open.
P_SCOPE = frozenset("td th li div article section body button".split())
LISTS = frozenset("ul ol dl table select menu".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SURE, MOST_SHARE = 50.0, 0.6


class Element:
    __slots__ = ("tag", "parent", "depth", "off", "off_word", "on", "article", "chars", "ended", "open_p", "scope", "foreign", "mark", "flushed")

    def __init__(self, tag: str, parent: "Element | None", attributes: str):
        self.tag, self.parent, self.chars, self.ended = tag, parent, 0, False
        self.depth = parent.depth + 1 if parent else 0
        words, hidden = _attributes(attributes) if attributes and tag not in ("html", "body") else ((), False)
        article = tag in ("article", "main") or "main" in words and tag in ("div", "section")
        self.article = article or bool(parent and parent.article)
        self.off = bool(parent and parent.off) or hidden or tag in OFF_TAGS or tag == "header" and not self.article
        self.off_word = any(w in OFF_WORDS for w in words if not (self.article and w == "header"))
        self.on = bool(parent and parent.on) or not ON_WORDS.isdisjoint(words)
        # the nearest open paragraph, the nearest list, table or item, and the svg or math that this is in
        self.open_p = self if tag == "p" else None if tag in P_SCOPE or not parent else parent.open_p
        self.scope = self if tag in CLOSES or tag in LISTS else parent.scope if parent else None
        self.foreign = self if tag in ("svg", "math") else parent.foreign if parent else None


def _attributes(text: str) -> tuple[set[str], bool]:
    words: set[str] = set()
    hidden = False
    for name, a, b, c in _ATTRIBUTE.findall(text):
        name, value = name.lower(), a or b or c
        if name == "hidden":
            hidden |= value.lower() != "false"
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "style":
            hidden |= bool(_HIDDEN.search(value))
        else:
            words.update(w.lower() for w in _PART.findall(value))
            words.update(w for w in re.split(r"[^a-z]+", value.lower()) if w)
    return words, hidden


class Block:
    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: Element, linked: int):
        self.text, self.element, self.linked = text, element, linked


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in order."""
    out: list[Block] = []
    root = here = Element("#page", None, "")
    elements, opened = [root], Counter()
    parts: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(Block(text, here, min(linked, len(text))))
            here.chars += len(text)
        linked = 0

    def back_to(e: Element) -> None:
        """Closes all elements inside ``e``."""
        nonlocal here
        while here is not e:
            opened[here.tag] -= 1
            here = here.parent

    def add(text: str) -> None:
        nonlocal linked
        if "&" in text:
            text = entities.unescape(text)
        parts.append(text)
        if links:
            linked += len(text.strip())

    at, n = 0, len(page)
    last = page.rfind(">") + 1  # no tag ends after it
    while at < n:
        m = _TOKEN.search(page, at, last) if at < last else None
        if m is None:
            cut = _UNFINISHED.search(page, max(at, last))
            add(page[at:cut.start()] if cut else page[at:])
            break
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:  # a comment, a declaration
            if m[0].startswith("<!--") and not m[0].endswith("-->") or m[0].startswith("<![CDATA[") and not m[0].endswith("]]>"):
                break
            continue
        tag = tag.lower()
        if m[1]:  # an end tag
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK:
                flush()
            elif tag in GAP:
                parts.append(" ")
            if opened[tag]:
                e = here
                while e.tag != tag:
                    e = e.parent
                e.ended = True
                if tag in INSTEAD:  # drop its text, without what went to blocks inside, which are off
                    del parts[e.mark if e.flushed == len(out) else 0:]
                    parts.append(" ")
                back_to(e.parent)
                if tag in BLOCK:
                    links = 0
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                close = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(page, at)
                at = close.end() if close else n
            if tag == "iframe":
                parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            links = 0 if tag not in ("li", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6") else links
            if here.foreign:  # a block ends an svg or math that was left open
                e = here.foreign
                while e.parent.foreign:
                    e = e.parent.foreign
                back_to(e.parent)
            if here.open_p:  # a paragraph that is still open ends here
                back_to(here.open_p.parent)
        elif tag in GAP:
            parts.append(" ")
        if tag in CLOSES:
            e = here.scope
            while e and e.tag not in LISTS:
                if e.tag in CLOSES[tag]:
                    back_to(e.parent)
                    break
                e = e.parent.scope
        if tag == "a":
            links = 1
        if tag not in VOID and not m[3].endswith("/"):
            here = Element(tag, here, m[3])
            here.mark, here.flushed = len(parts), len(out)
            elements.append(here)
            opened[tag] += 1
    flush()
    for e in reversed(elements[1:]):
        e.parent.chars += e.chars
    for e in elements[1:]:  # parents first
        e.off = e.off or e.parent.off or e.tag in INSTEAD and e.ended or e.off_word and e.chars <= MOST_SHARE * root.chars
    return out


def odds(block: Block, total: int) -> float:
    """Log odds of content for one block of a page with ``total`` characters of text."""
    e = block.element
    if e.off:
        return -SURE
    words = block.text.count(" ") + 1
    link = block.linked / len(block.text)
    heading = e.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
    u = -1.0 + 3.0 * e.article + 0.8 * e.on + 0.6 * (e.tag in ("p", "blockquote", "pre")) + 0.5 * heading
    u += 0.03 * min(words, 60) + 0.5 * bool(_END.search(block.text))
    u -= 3.5 * link * (words < 30) + 1.0 * (e.tag == "li" and words < 4)
    if not e.article and words < 40 and ("©" in block.text or "all rights reserved" in block.text.lower()):
        u -= 3.0
    return u


def _steps(a: Element, b: Element, most: int = 8) -> int:
    """Steps between two elements through their nearest common ancestor, at most ``most``."""
    n = 0
    while a is not b and n < most:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours, and between neighbours among the blocks of one parent."""
    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            out.append((i - 1, i, 1.2 / (1 + _steps(found[i - 1].element, b.element))))
        family = id(b.element.parent or b.element)
        if family in last and last[family] != i - 1:
            out.append((last[family], i, 0.4))
        last[family] = i
    return out


def min_cut(unary: list[float], pairs: list[tuple[int, int, float]]) -> list[bool]:
    """True for content: the labelling with the least sum of overruled odds and cut edges."""
    n = len(unary)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in pairs:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    u, label = list(unary), [None] * n
    todo = deque(range(n))
    while todo:  # a block whose odds outweigh its edges is settled, and leans on its neighbours
        i = todo.popleft()
        if label[i] is None and abs(u[i]) >= sum(near[i].values()):
            label[i] = u[i] > 0
            for j, w in near[i].items():
                u[j] += w if label[i] else -w
                del near[j][i]
                if label[j] is None:
                    todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, content in zip(left, _max_flow(left, u, near)):
            label[i] = content
    return label


def _max_flow(left: list[int], u: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Sides of a minimum cut of the blocks in ``left``: reachable from the content terminal or not."""
    place = {i: k for k, i in enumerate(left)}
    s, t = len(left), len(left) + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(t + 1)]

    def join(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((there, back))

    for i in left:
        k = place[i]
        if u[i] > 0:
            join(s, k, u[i], 0.0)
        elif u[i] < 0:
            join(k, t, -u[i], 0.0)
        for j, w in near[i].items():
            if j in place and i < j:
                join(k, place[j], w, w)
    tiny = 1e-12
    while True:
        level = [-1] * (t + 1)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[place[i]] >= 0 for i in left]
        turn = [0] * (t + 1)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                first = next(k for k, e in enumerate(path) if cap[e] <= tiny)
                a = to[path[first] ^ 1]
                del path[first:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if cap[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(out[a]):
                path.append(out[a][turn[a]])
                a = to[path[-1]]
            elif a == s:
                break
            else:
                level[a] = -1
                a = to[path.pop() ^ 1]


def main_text(page: str | None) -> str:
    """The text of a page's content blocks."""
    if not page or page.isspace():
        return ""
    found = blocks(page)
    total = sum(len(b.text) for b in found)
    keep = min_cut([odds(b, total) for b in found], edges(found))
    return "\n\n".join(b.text for b, yes in zip(found, keep) if yes)


def extract(pages: DataFrame, html_col: str = "html", out: str = "text", keep_html: bool = True) -> DataFrame:
    """``pages`` with the main text of ``html_col``; without the html if ``keep_html`` is false."""
    gone = {out} if keep_html else {out, html_col}
    schema = T.StructType([f for f in pages.schema.fields if f.name not in gone] + [T.StructField(out, T.StringType())])
    names = schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, html_col):
            texts = pa.array([main_text(p) for p in texts_of(b.column(html_col)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), texts], names=schema.names)

    return pages.mapInArrow(run, schema)
