"""Leaf blocks of HTML pages: stretches of text between block elements, with what surrounds them.

Inline elements do not cut a block.  Elements are closed as browsers do for unclosed p, li, dt, dd, option and table parts; text of
script, style, template, svg, iframe, object and the head is no text of the page.  A page that ends inside a tag loses that tag only.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

#: A comment, declaration or tag (its name and attributes, quoted values whole), and the beginning of one that the page cuts off.
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?/][^>]*>", re.DOTALL)
_CUT_OFF = re.compile(r"<[a-zA-Z/!?].*", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_TOKENS_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Fixed values of HTML: elements without content, inside a line, without text of the page, and those whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var ruby rb rt rp".split())
SILENT = frozenset("head script style template svg math iframe object audio video canvas noscript".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Fixed values of HTML: what a start tag closes, and where that search ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
CLOSE_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
NAMED = ("class", "id", "role", "itemprop")
#: Elements that are open within each other; further ones count as part of the innermost, as in browsers.
DEEPEST = 512


@dataclass(slots=True)
class Block:
    """A leaf block: its text, characters of it in links, the marks of its ancestors, its element's own, and that element's number."""

    text: str
    linked: int
    around: tuple[str, ...]
    own: tuple[str, ...]
    element: int


@dataclass(slots=True)
class Page:
    title: str = ""
    blocks: list[Block] = field(default_factory=list)


@functools.lru_cache(1 << 14)
def _marks(tag: str, attrs: str) -> tuple[str, ...]:
    """What an element shows of its purpose: tag, and the words of its class, id and role."""
    out = ["<" + tag]
    for name, value in _ATTRIBUTE.findall(attrs):
        name = name.lower()
        if name in NAMED:
            out += ["." + w.lower() for w in _TOKENS_OF_NAME.findall(unescape(value))]
        elif name in ("hidden", "aria-hidden") and "false" not in value:
            out.append("[hidden")
    return tuple(dict.fromkeys(out))


@functools.lru_cache(64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE)


class _Reader:
    def __init__(self):
        self.page, self.parts, self.links = Page(), [], []
        self.stack: list[tuple[str, tuple[str, ...], tuple[str, ...], int]] = [("", (), (), 0)]
        self.elements, self.in_link, self.silent, self.open = 0, False, 0, Counter()

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, around, own, element = self.stack[-1]
                self.page.blocks.append(Block(text, len(" ".join("".join(self.links).split())), around, own, element))
            self.parts, self.links = [], []

    def text(self, text: str) -> None:
        if text and not self.silent:
            text = unescape(text) if "&" in text else text
            self.parts.append(text)
            if self.in_link:
                self.links.append(text)

    def pop_to(self, depth: int) -> None:
        self.flush()
        self.in_link = False
        for tag, *_ in self.stack[depth:]:
            self.silent -= tag in SILENT
            self.open[tag] -= 1
        del self.stack[depth:]

    def find(self, tags, until=frozenset()) -> int:
        """The depth of the nearest open element of these tags, not looking beyond `until`; 0 if there is none."""
        for depth in range(len(self.stack) - 1, 0, -1) if any(self.open[t] > 0 for t in tags) else ():
            tag = self.stack[depth][0]
            if tag in tags:
                return depth
            if tag in until:
                return 0
        return 0

    def start(self, tag: str, attrs: str) -> None:
        if tag in INLINE:
            self.in_link = self.in_link or tag == "a"
            return
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self.flush()
            return
        self.flush()
        if tag in CLOSE_P and (depth := self.find({"p"}, {"td", "th", "button", "object", "table"})):
            self.pop_to(depth)
        if tag in CLOSES and (outermost := self.find(*CLOSES[tag])):
            closed, until = CLOSES[tag]
            while (further := next((d for d in range(outermost - 1, 0, -1) if self.stack[d][0] in closed | until), 0)) and self.stack[further][0] in closed:
                outermost = further
            self.pop_to(outermost)
        if tag == "body" and (depth := self.find({"head"})):
            self.pop_to(depth)
        self.in_link = False
        if len(self.stack) > DEEPEST:
            return
        own = _marks(tag, attrs)
        around = self.stack[-1][1]
        self.elements += 1
        self.stack.append((tag, around + tuple(m for m in own if m not in around), own, self.elements))
        self.silent += tag in SILENT
        self.open[tag] += 1

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        elif tag == "br":
            self.parts.append(" ")
        elif tag not in INLINE and (depth := self.find({tag})):
            self.pop_to(depth)

    def read(self, html: str) -> Page:
        at, last = 0, html.rfind(">") + 1
        html, tail = html[:last], html[last:]
        while (found := _TOKEN.search(html, at)) is not None:
            self.text(html[at : found.start()])
            at = found.end()
            name = found["name"]
            if name is None:
                comment = found.group()
                if comment.startswith("<!--") and not comment.endswith(("->", "-!>", "<!-->")):
                    tail = ""  # it never ends
                continue
            tag = name.lower()
            if found["end"]:
                self.end(tag)
                continue
            self.start(tag, found["attrs"])
            if tag in RAW:
                stop = _end_of(tag).search(html, at)
                inside = html[at : stop.start() if stop else len(html)]
                if tag == "title" and not self.page.title:
                    self.page.title = " ".join(unescape(inside).split())
                elif tag not in SILENT and tag != "title":
                    self.text(inside)
                at, tail = (stop.start(), tail) if stop else (len(html), "")
        self.text(html[at:] + _CUT_OFF.sub("", tail))
        self.flush()
        return self.page


def read(html: str | None) -> Page:
    """The leaf blocks of a page, in page order; none of a null or empty one."""
    return _Reader().read(html or "")
