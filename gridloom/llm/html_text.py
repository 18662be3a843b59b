"""Main text of web pages by tag-path ratios.

A page is read into text nodes, one per block, each with its path of block tags from the root. Text length and
punctuation are aggregated per path; both ratios are smoothed over neighbouring nodes of one parent and fused, and paths
whose mean exceeds a threshold set by the spread are content paths. Their nodes are content. The content region is the
article or main element that holds most content, else the lowest element around it; its other blocks (headings, short
lines, cells) belong to the text too, unless they are paths of links or, beyond the content, lie in containers.

Elements that never are main text (menus, forms, adverts, ...) are left out unseen: by their tag, or by a class, id or
role that consists of marking words only. Where a marking word is only a part of such a name, the ratios decide. Reader
comments go by their names in whatever company, and without a name by their paths: siblings of one path that nearly all
begin with a line on who wrote when.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import map_texts, strings

#: Elements whose content is text to the parser, and elements that never hold main text (fixed by HTML).
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
NEVER = {"head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "textarea", "iframe", "svg", "canvas", "object", "video", "audio", "dialog", "menu", "title", "xmp", "noembed", "noframes"}
#: Elements without content, and elements that run on within a line.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img"}
#: Elements that an opening tag of the same set closes.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in a class, id or role that mark something other than main text, and words that may stand beside them there.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|alert|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|sidebar|side|aside|widget|footer|foot|header|masthead|topbar|share|sharing|social|related|recommended|comment|comments|reply|replies|respond|disqus|subscribe|newsletter|signup|login|popup|modal|overlay|pagination|pager|search|toolbar|skip|hidden|complementary|contentinfo)(?=$|[\s_-])"
).search
BESIDE = frozenset("page site main global top bottom left right center inner outer primary secondary the list item items box wrap wrapper container content section block area bar slot row col column unit text panel pane button buttons icon icons link links post posts article articles form thread message group body holder bg js module".split())
#: Parts of names that mark reader comments, whatever stands beside them but for words of a page's state; ``discussion`` does
#: not on a section, which may be a part of the article.
COMMENTS = re.compile(r"comments?(?:list|area|box|form|thread|section|wrap|wrapper|body|text|author)?|commenters?|discussions?|disqus|replies|responses").fullmatch
STATES = frozenset("has with without no open opened closed enabled disabled allow allowed on off".split())
#: Words that make a header that of the article, which holds its title.
TITLED = frozenset("article post entry story content".split())
#: A line about who wrote when, or what to do about it: short, and with a time, a day or one of these words.
BYLINE, BYLINE_CHARS = re.compile(r"\b\d{1,2}:\d{2}\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b|\bago\b|\breply\b|\bantworten\b|\brépondre\b|\bresponder\b", re.I).search, 60
#: Siblings of one path, at least, and blocks of each, at most, that are reader comments if nearly all have such a line.
REPLIES, REPLY_BLOCKS, REPLY_SHARE = 3, 5, 0.8
#: Smoothing weights of a node and its neighbours, threshold in standard deviations, share of link text that makes a path
#: one of links, and share of unlinked content text that keeps an element whose name has a marking word as a part.
SMOOTH, SPREAD, LINKS, SHARE = (0.1, 0.2, 0.4, 0.2, 0.1), 0.5, 0.5, 0.5
#: Elements that hold text rather than other blocks: beyond the content they belong to it where containers do not.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "table", "pre", "blockquote", "figure", "details", "address"}

#: A comment, a declaration, or a tag with its attributes; where quotes do not pair up a tag ends at the next ">".
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+(?=>)|[^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)").search
_PUNCTUATION = re.compile(r"[.,;:!?…。，？！،؟।]")


class Element:
    """An open block: its parent, its serial number and that of its tag path, the article or main element and the
    element of doubtful name that it lies in or is."""

    __slots__ = ("doubtful", "named", "parent", "path", "serial", "tag")

    def __init__(self, tag: str, parent: Element | None, serial: int, path: int, doubtful: bool):
        self.tag, self.parent, self.serial, self.path = tag, parent, serial, path
        self.named: Element | None = self if tag in ("article", "main") else parent and parent.named
        self.doubtful: Element | None = self if doubtful else parent and parent.doubtful


class Node:
    """A block of text: the element it lies in, its text, and its characters in links."""

    __slots__ = ("element", "linked", "text")

    def __init__(self, element: Element, text: str, linked: int):
        self.element, self.text, self.linked = element, text, linked


def _marked(tag: str, attributes: str, in_article: bool) -> float:
    """1 for an element that holds no main text, 0 for one that may, and between where only a part of its name marks it."""
    if tag in NEVER or (tag == "header" and not in_article):
        return 1
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or _HIDDEN(_ATTRIBUTE.sub("", attributes)) or "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("aria-hidden") == "true":
        return 1
    most = 0.0
    for key in ("class", "id", "role"):
        for name in found.get(key, "").lower().split():
            parts = [p for p in re.split(r"[_\d-]+", name) if p]
            if any(map(COMMENTS, parts)) and STATES.isdisjoint(parts):
                if tag != "section" or not parts[-1].startswith("discussion"):
                    return 1
            elif MARKS(name):
                marks = {p for p in parts if MARKS(p)}
                if marks == {"header"} and (in_article or not TITLED.isdisjoint(parts)):
                    continue
                alone = all(p in BESIDE or p in marks for p in parts) and not (in_article and tag == "p" and marks == {"alert"})
                most = max(most, 1 if alone else 0.5)
    return most


def nodes(html: str) -> tuple[list[Node], list[Element]]:
    """The text nodes of a page in page order, without those in elements that hold no main text, and all elements in the
    order of their start; the first is the page itself."""
    out: list[Node] = []
    top = Element("", None, 0, 0, False)
    elements = [top]
    current = top
    open_tags: Counter = Counter()
    paths: dict[tuple[int, str], int] = {}
    parts: list[str] = []
    links = linked = 0
    dropped: list[str] = []  # open elements from the outermost one that is left out
    in_dropped: Counter = Counter()
    blocks = [0]  # after each of them, how many there are up to the last block
    at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append(Node(current, text, linked))
        linked = 0

    def read(text: str) -> None:
        nonlocal linked
        if text and not dropped:
            parts.append(text)
            if links:
                linked += len(text.strip())

    def drop(tag: str) -> None:
        dropped.append(tag)
        in_dropped[tag] += 1
        blocks.append(blocks[-1] if tag in INLINE else len(dropped))

    def undrop(size: int) -> None:
        while len(dropped) > size:
            in_dropped[dropped.pop()] -= 1
            blocks.pop()

    def leave() -> None:
        nonlocal current
        open_tags[current.tag] -= 1
        current = current.parent

    # Beyond the last ">" there is no tag, which keeps the search from scanning on for one.
    end_of_tags = html.rfind(">") + 1
    while match := _TOKEN.search(html, at, end_of_tags):
        read(html[at : match.start()])
        at = match.end()
        if match[2] is None:
            continue
        tag, closing, attributes = match[2].lower(), bool(match[1]), match[3]
        if not closing and tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            if not dropped and tag not in INLINE:
                flush()
            continue
        if dropped:
            if closing:
                if in_dropped[tag]:
                    while dropped[-1] != tag:
                        undrop(len(dropped) - 1)
                    undrop(len(dropped) - 1)
                    continue
                # The end of an element around the dropped one ends that too and is read below; ends of runs of text are not.
                if tag in INLINE or not open_tags[tag]:
                    continue
                undrop(0)
            elif tag in VOID or attributes.endswith("/"):
                continue
            else:
                implied = CLOSES.get(tag, set() if tag in INLINE or tag in ("body", "html") else {"p"})
                block = blocks[-1]
                if block and dropped[block - 1] in implied:
                    undrop(block - 1)
                elif not block and current.tag in implied:
                    undrop(0)
                if dropped:
                    drop(tag)
                    continue
        mark = _marked(tag, attributes, bool(open_tags["article"] or open_tags["main"])) if not closing and tag not in VOID else 0
        if mark == 1:
            flush()
            drop(tag)
            continue
        if tag in ("br", "wbr", "img"):
            if tag == "br":
                read(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if open_tags[tag]:
                while current.tag != tag:
                    leave()
                leave()
                links = 0
            continue
        implied = CLOSES.get(tag, {"p"} if tag not in ("body", "html") else set())
        while current.tag in implied:
            leave()
        current = Element(tag, current, len(elements), paths.setdefault((current.path, tag), len(paths) + 1), mark > 0)
        open_tags[tag] += 1
        elements.append(current)
    read(html[at:])
    flush()
    return out, elements


def smoothed(found: list[Node], values: list[float]) -> list[float]:
    """Values averaged over neighbours in page order below the same parent element."""
    reach = len(SMOOTH) // 2
    out = []
    for i, node in enumerate(found):
        weight = total = 0.0
        for k, w in enumerate(SMOOTH):
            j = i + k - reach
            if 0 <= j < len(found) and found[j].element.parent is node.element.parent:
                weight += w
                total += w * values[j]
        out.append(total / weight)
    return out


def content_paths(found: list[Node]) -> set[int]:
    """The content paths: length and punctuation per node of a path, smoothed along the page, fused, and thresholded."""
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for node in found:
        total = sums[node.element.path]
        total[0] += 1
        total[1] += max(0, len(node.text) - 2 * node.linked)
        total[2] += len(_PUNCTUATION.findall(node.text))
    lengths = smoothed(found, [sums[n.element.path][1] / sums[n.element.path][0] for n in found])
    marks = smoothed(found, [sums[n.element.path][2] / sums[n.element.path][0] for n in found])
    values = [length * (1 + mark) for length, mark in zip(lengths, marks, strict=True)]
    mean = sum(values) / len(values)
    least = SPREAD * math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    by_path: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for node, value in zip(found, values, strict=True):
        by_path[node.element.path][0] += 1
        by_path[node.element.path][1] += value
    return {path for path, (n, total) in by_path.items() if total > 0 and total / n >= least}


def replies(found: list[Node], elements: list[Element], content: list[bool]) -> set[int]:
    """The serial numbers of elements that are reader comments: behind content, several siblings of one path, of a few
    blocks each, nearly all with a byline among the first two."""
    if not any(BYLINE(n.text) for n in found if len(n.text) <= BYLINE_CHARS):
        return set()
    held, before, bylines = [0] * len(elements), [0] * len(elements), [False] * len(elements)
    first: list[int | None] = [None] * len(elements)
    for i, node in enumerate(found):
        e = node.element
        held[e.serial] += 1
        if first[e.serial] is None:
            first[e.serial] = i
    lines = [len(n.text) <= BYLINE_CHARS and n.element.tag not in ("h1", "h2", "h3", "h4", "h5", "h6", "dt", "td", "th") and bool(BYLINE(n.text)) for n in found]
    good = [0]
    for c in content:
        good.append(good[-1] + c)
    for e in reversed(elements[1:]):
        up, own = e.parent.serial, first[e.serial]
        held[up] += held[e.serial]
        if own is not None and (first[up] is None or own < first[up]):
            first[up] = own
    groups: dict[tuple[int, int], list[Element]] = defaultdict(list)
    for e in elements[1:]:
        own = first[e.serial]
        if own is not None and e.tag in ("li", "div", "article"):
            groups[e.parent.serial, e.path].append(e)
            bylines[e.serial] = 2 <= held[e.serial] <= REPLY_BLOCKS and any(lines[own : own + 2])
            before[e.serial] = good[own]
    out: set[int] = set()
    for group in groups.values():
        if len(group) >= REPLIES and sum(bylines[e.serial] for e in group) >= REPLY_SHARE * len(group) and before[group[0].serial]:
            out.update(e.serial for e in group)
    return out


def main_text(html: str) -> str:
    """The main text of a page: its blocks, each with single spaces, joined by line feeds; empty if there is none."""
    found, elements = nodes(html)
    if not found:
        return ""
    chosen = content_paths(found)
    content = [n.element.path in chosen for n in found]
    if not any(content):
        content = [True] * len(found)
    first, last = content.index(True), len(found) - 1 - content[::-1].index(True)
    region = _region([n for n, c in zip(found, content, strict=True) if c], elements)
    comments = replies(found, elements, content)
    in_comments = [False] * len(elements)
    for e in elements[1:] if comments else ():
        in_comments[e.serial] = e.serial in comments or in_comments[e.parent.serial]

    # Of each element: the child of the region that it lies in or is, or the region itself; None outside.
    below: list[Element | None] = []
    for e in elements:
        outer = e.parent and below[e.parent.serial]
        below.append(e if e is region or outer is region else outer)
    links: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    doubtful: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for node, good in zip(found, content, strict=True):
        of_path = links[node.element.path]
        of_path[0] += len(node.text)
        of_path[1] += node.linked
        if node.element.doubtful:
            share = doubtful[node.element.doubtful.serial]
            share[0] += len(node.text)
            share[1] += (len(node.text) - node.linked) * good
    out = []
    for i, (node, good) in enumerate(zip(found, content, strict=True)):
        e = node.element
        child = below[e.serial]
        if child is None or in_comments[e.serial]:
            continue
        if e.doubtful and (share := doubtful[e.doubtful.serial])[1] < SHARE * share[0]:
            continue
        if not good and region.named is not region:
            size, linked = links[e.path]
            if linked > LINKS * size or not (first <= i <= last or child is region or child.tag in PROSE):
                continue
        out.append(node.text)
    return "\n".join(out)


def _region(chosen: list[Node], elements: list[Element]) -> Element:
    """The element that holds the content: the article or main element with most of it, else the lowest one around all."""
    size: dict[int, int] = defaultdict(int)
    for node in chosen:
        if node.element.named:
            size[node.element.named.serial] += len(node.text)
    if size:
        best = max(size, key=lambda serial: size[serial])
        if 2 * size[best] >= sum(len(n.text) for n in chosen):
            return elements[best]
    held = [0] * len(elements)
    for node in chosen:
        # A block stands for its parent: what lies beside it may belong to the text.
        held[(node.element.parent or node.element).serial] += 1
    for e in reversed(elements[1:]):
        if held[e.serial] == len(chosen):
            return e
        held[e.parent.serial] += held[e.serial]
    return elements[0]


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add ``main_text`` to the columns ``keep``.

    Null pages count as empty and give an empty text, as do pages without main text. Malformed pages are read as far as
    they go. Time and memory are linear in a page's length, however deep its elements nest. Rows are independent, so
    repeated rows, ties and empty tables need no care; ``main_text`` takes the place of a kept column of that name.
    """

    def make():
        return lambda batch: {"main_text": pa.array(list(map(main_text, strings(batch.column(0)))), pa.string())}

    return map_texts(pages, {"html": html_col}, make, T.StructType([T.StructField("main_text", T.StringType())]), pages.columns if keep is None else keep)


