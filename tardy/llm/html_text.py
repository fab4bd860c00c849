"""Markup to text blocks with their places in the element tree.

A small forgiving reader of HTML: block elements form the tree, inline
elements only carry text.  A block is the text between two block borders.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from urllib.parse import urlsplit

from xxhash import xxh3_64_intdigest

_TAG = re.compile(r"<!--.*?-->|<!--.*\Z|<(/?)([a-zA-Z][^\s/>]*+)"
                  r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?/][^>]*+>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|$|=|/)", re.I)
_NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
_CUT_TAG = re.compile(r"<[a-zA-Z/!?]")

# fixed values of the markup language: elements without an end tag, with raw
# text, not shown as text, that are blocks, and those that an opening tag ends
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style title template noscript iframe object svg math canvas audio video map".split())
BLOCKS = frozenset(("address article aside blockquote body center dd details dialog dir div dl dt fieldset "
                    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav "
                    "ol option p pre search section select summary table tbody td tfoot th thead tr ul "
                    "button caption head template object svg math canvas audio video map").split())
ENDS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
        "tr": ("tr td th", ("table",)), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)),
        "tbody": ("tbody thead tfoot tr td th", ("table",)), "option": ("option", ("select",)),
        "body": ("head", ("html",))}
INSIDE_P = BLOCKS - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option",
                     "button", "object", "svg", "math", "canvas", "audio", "video", "map"}

_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in RAW}

#: what markup itself names as no part of the article
BOILERPLATE_TAGS = frozenset("nav aside footer form search dialog menu button select fieldset".split())
BOILERPLATE_ROLES = frozenset(("navigation banner contentinfo complementary search dialog alert alertdialog form "
                               "menu menubar toolbar").split())
BOILERPLATE_WORDS = frozenset((
    "nav navbar navigation navi menu topbar breadcrumb breadcrumbs masthead footer copyright sidebar sidebars aside "
    "rail widget widgets related recommended cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe signup ad ads advert adverts advertisement advertisements advertising sponsor sponsored "
    "promo promotion share sharing social comment comments disqus reply replies form search login pagination "
    "pager toolbar").split())
#: these name the page's head outside the article, and a heading inside
HEAD_WORDS = frozenset(("header", "banner", "head"))
COMMENT_WORDS = frozenset("comment comments disqus reply replies".split())
LANDMARK_WORDS = frozenset(("article", "articlebody", "post", "entry", "story", "content", "maincontent", "main"))

#: deeper elements are read as children of the one at this depth; their text stays
DEPTH = 24

def node_id(text: str) -> int:
    return xxh3_64_intdigest(text) >> 1


@dataclass(slots=True)
class Element:
    tag: str
    label: str
    node: int
    path: tuple[int, ...]
    named: bool  # markup names it as boilerplate
    unseen: bool
    landmark: bool  # in an article or main element
    likely: bool  # in an element whose class calls it content
    kids: list[Element] = field(default_factory=list)


@dataclass(slots=True)
class Block:
    element: Element
    text: str


def host_of(url: str | None) -> str:
    """The host of an address, without its port; empty if there is none."""
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


def _attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _open(parent: Element, tag: str, raw: str) -> Element:
    attrs = _attributes(raw) if "=" in raw else {}
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    label = ".".join([tag, *sorted(set(_DIGITS.sub("0", names).split()))])
    path = parent.path[:DEPTH - 1]
    node = node_id(f"{path[-1]}>{label}")
    role = attrs.get("role", "").lower()
    words = {w.lower() for w in _TOKEN.findall(names)}
    landmark, named = parent.landmark, parent.named
    if tag in ("article", "main") or role in ("main", "article"):
        named = named or bool(words & COMMENT_WORDS)
        landmark = not named
    elif tag != "body" and (tag in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES or words & BOILERPLATE_WORDS
                            or not landmark and (tag == "header" or words & HEAD_WORDS)):
        named = True
    hidden = bool(raw) and (attrs.get("aria-hidden") == "true" or _HIDDEN.search(raw) is not None
                            or _NOT_SHOWN.search(attrs.get("style", "")) is not None)
    likely = parent.likely or (tag != "body" and not named and bool(words & LANDMARK_WORDS))
    return Element(tag, label, node, path + (node,), named, parent.unseen or tag in UNSEEN or hidden,
                   landmark, likely)


class _Reader:
    def __init__(self) -> None:
        root = node_id("html")
        self.stack = [Element("html", "html", root, (root,), False, False, False, False)]
        self.elements = [self.stack[0]]
        self.blocks: list[Block] = []
        self.buffer: list[str] = []
        self.open = Counter(["html"])

    def flush(self) -> None:
        text = "".join(self.buffer)
        self.buffer.clear()
        if "&" in text:
            text = html.unescape(text)
        text = " ".join(text.split())
        if text and not self.stack[-1].unseen:
            self.blocks.append(Block(self.stack[-1], text))

    def cut(self, k: int) -> None:
        """End the elements from the k-th open one on."""
        self.flush()
        for e in self.stack[k:]:
            self.open[e.tag] -= 1
        del self.stack[k:]

    def end_implied(self, tags: str, scope: tuple[str, ...]) -> None:
        """End the outermost of these elements within the nearest scope."""
        found = None
        wanted = tags.split()
        if not any(self.open[t] for t in wanted):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in scope:
                break
            if self.stack[k].tag in wanted:
                found = k
        if found:
            self.cut(found)

    def start(self, tag: str, raw: str) -> None:
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag == "br":
                self.buffer.append(" ")
            return
        if tag not in BLOCKS or tag == "html" or (tag == "body" and self.open["body"]):
            return
        self.flush()
        if tag in INSIDE_P:
            self.end_implied("p", ("button", "td", "th", "caption", "object"))
        if tag in ENDS:
            self.end_implied(*ENDS[tag])
        element = _open(self.stack[-1], tag, raw)
        self.stack[-1].kids.append(element)
        self.elements.append(element)
        if not (raw.endswith("/") and tag in ("svg", "math")):
            self.stack.append(element)
            self.open[tag] += 1

    def end(self, tag: str) -> None:
        if tag == "br":
            self.buffer.append(" ")
        elif tag in BLOCKS and tag not in ("html", "body") and self.open[tag]:
            k = len(self.stack) - 1
            while self.stack[k].tag != tag:
                k -= 1
            self.cut(k)
        elif tag == "p":
            self.flush()  # a stray end is an empty paragraph


def read_page(page: str) -> tuple[list[Block], list[Element]]:
    """(text blocks in page order, elements) of a page.

    White space inside a block is one space; character references are
    decoded.  Elements that are not shown have no blocks; a tag that the
    page's end cuts off is dropped.
    """
    reader, at, end = _Reader(), 0, page.rfind(">") + 1
    while m := _TAG.search(page, at, end):
        reader.buffer.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:  # a comment or declaration
            continue
        tag = m[2].lower()
        if m[1]:
            reader.end(tag)
        elif tag in RAW:
            stop = _RAW_END[tag].search(page, at)
            at = stop.end() if stop else len(page)
        else:
            reader.start(tag, m[3])
    cut = _CUT_TAG.search(page, at)
    reader.buffer.append(page[at:cut.start() if cut else len(page)])
    reader.flush()
    return reader.blocks, reader.elements
