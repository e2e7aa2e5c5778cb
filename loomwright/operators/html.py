"""Page metadata, links and markdown from HTML, by the standard library's parser in Arrow batches.

The markdown is a documented subset: headings, paragraphs, list items, links,
and pre as [code] blocks.  Main content is the first article, else main, else body.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: The selectors whose elements are removed before the content is read.
REMOVED = ("nav", "header", "footer", ".sidebar", ".navigation", ".breadcrumb", "#table-of-contents")
BLOCKS = frozenset("p div section article main li ul ol table tr blockquote pre h1 h2 h3 h4 h5 h6 br".split())

#: An ampersand that begins no reference with a semicolon.
OPEN_REFERENCE = re.compile(r"&(?!(?:[a-zA-Z][a-zA-Z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);)")


def matches(tag: str, attrs: dict, selector: str) -> bool:
    """Whether an element meets a selector: tag, .class, #id, or tag.class."""
    if selector.startswith("#"):
        return attrs.get("id") == selector[1:]
    name, _, kind = selector.partition(".")
    return (not name or tag == name) and (not kind or kind in (attrs.get("class") or "").split())


class _Page(HTMLParser):
    def __init__(self, removed: tuple[str, ...], selectors: tuple[tuple[str, str], ...] = ()):
        super().__init__(convert_charrefs=True)
        #: Texts of the first element of each selector, and the open ones as [key, depth of its tag, tag].
        self.custom: dict[str, list[str]] = {}
        self.selectors, self.open = selectors, []
        self.removed, self.title, self.metas, self.links = removed, None, {}, []
        self.skipping: list[str] = []
        self.in_title = False
        self.stack: list[str] = []
        self.out: dict[str, list[str]] = {"article": [], "main": [], "body": []}
        self.pre = 0
        self.href: list[str | None] = []

    def _emit(self, text: str) -> None:
        for where, parts in self.out.items():
            if where == "body" or where in self.stack:
                parts.append(text)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "meta":
            name = attrs.get("name") or attrs.get("property")
            if name and attrs.get("content"):
                self.metas[name] = attrs["content"]
        if tag == "a" and attrs.get("href") is not None:
            self.links.append(attrs["href"])
        if tag == "title" and self.title is None:
            self.in_title, self.title = True, ""
        for one in self.open:
            one[1] += one[2] == tag and tag not in VOID
        for key, selector in self.selectors:
            if key not in self.custom and matches(tag, attrs, selector):
                self.custom[key] = []
                if tag not in VOID:
                    self.open.append([key, 1, tag])
        if self.skipping:
            if tag == self.skipping[-1]:
                self.skipping.append(tag)
            return
        if tag in ("script", "style", "head") or any(matches(tag, attrs, s) for s in self.removed):
            if tag not in VOID:
                self.skipping = [tag]
            return
        if tag not in VOID:
            self.stack.append(tag)
        if re.fullmatch("h[1-6]", tag):
            self._emit("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self._emit("\n- ")
        elif tag == "pre":
            self.pre += 1
            self._emit("\n\n[code]\n")
        elif tag == "br":
            self._emit("\n")
        elif tag in BLOCKS:
            self._emit("\n\n")
        elif tag == "a":
            self.href.append(attrs.get("href"))
            self._emit("[")

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        for one in self.open:
            one[1] -= one[2] == tag
        self.open = [one for one in self.open if one[1]]
        if self.skipping:
            if tag == self.skipping[-1]:
                self.skipping.pop()
            return
        if tag in self.stack:
            while self.stack and self.stack.pop() != tag:
                pass
        if tag == "pre" and self.pre:
            self.pre -= 1
            self._emit("\n[/code]\n\n")
        elif tag == "a" and self.href:
            self._emit(f"]({self.href.pop() or ''})")
        elif tag in BLOCKS:
            self._emit("\n\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        for key, *_ in self.open:
            self.custom[key].append(data)
        if not self.skipping:
            self._emit(data if self.pre else re.sub(r"\s+", " ", data))

    def markdown(self) -> str:
        text = next(("".join(p) for p in self.out.values() if "".join(p).strip()), "")
        parts = re.split(r"(\[code\]\n.*?\n\[/code\])", text, flags=re.DOTALL)
        tidy = (p if i % 2 else re.sub(r"[ \t]+\n", "\n", re.sub(r"\n +", "\n", p)) for i, p in enumerate(parts))
        return re.sub(r"\n{3,}", "\n\n", "".join(tidy)).strip()


def parse(html: str, removed: tuple[str, ...] = REMOVED, selectors: tuple[tuple[str, str], ...] = (), closed: bool = False) -> _Page:
    """`closed` leaves references without a semicolon as they stand, as XHTML does; else they are decoded as browsers do."""
    page = _Page(removed, selectors)
    page.feed(OPEN_REFERENCE.sub("&amp;", html) if closed else html)
    page.close()
    return page


def page_parts(urls: Column, htmls: Column, selectors: dict[str, str] | None = None, removed: tuple[str, ...] = REMOVED, closed: bool = False, whole: bool = False) -> Column:
    """Title, meta tags, distinct absolute links without fragment in order, and markdown; a null page has none of them.

    `selectors` name further metadata by the element whose stripped text they are: a tag, .class, #id or tag.class, the first that
    matches; they replace a meta tag of the same name.  `closed` is as `parse` says; `whole` keeps the white space around the title and those texts.
    """
    wanted = tuple((selectors or {}).items())
    trimmed = str if whole else str.strip

    def run(url_series: pd.Series, html_series: pd.Series) -> pd.DataFrame:
        rows = []
        for url, html in zip(url_series, html_series):
            if html is None:
                rows.append((None, {}, [], None))
                continue
            page = parse(html, removed, wanted, closed)
            links = []
            for href in page.links:
                try:
                    links.append(urljoin(url or "", href).split("#")[0])
                except ValueError:
                    continue
            metas = page.metas | {key: trimmed("".join(parts)) for key, parts in page.custom.items()}
            rows.append((trimmed(page.title) if page.title is not None else None, metas, list(dict.fromkeys(links)), page.markdown()))
        return pd.DataFrame(rows, columns=["title", "metas", "links", "markdown"])

    run.__annotations__ = {"url_series": pd.Series, "html_series": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "struct<title:string,metas:map<string,string>,links:array<string>,markdown:string>")(urls, htmls)
