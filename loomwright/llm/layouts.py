"""Labelled pages: (html, main text) of many layouts, made from a seed, to train the extraction of main texts.

Words are invented, so nothing but layout, marks and the shape of texts can be learned from them.  The main text has the article's
headings, paragraphs, lists, quotations, tables and captions; menus, headers, footers, side bars, notices, adverts, forms and comments
around and inside it have none of it.
"""

from __future__ import annotations

import random
from html import escape

#: Letters and short words of the scripts that texts are made of.
_SCRIPTS = (
    ("bcdfghklmnprstvw", "aeiou", ("the", "of", "and", "to", "in", "is")),
    ("bcdfgklmnprstzß", "aeiouäöü", ("der", "und", "die", "für", "mit", "ein")),
    ("bcdfglmnpqrstv", "aeiouéèêç", ("le", "la", "des", "et", "en", "une")),
    ("бвгдклмнпрст", "аеиоуя", ("и", "в", "на", "не", "с", "что")),
)
#: Words that give a purpose away, as sites use them in class and id names; each list is one kind of element.
_NAMES = {
    "ad": "ad ads advert advertisement sponsored promo ad-slot ad-banner adsbygoogle banner-ad partner",
    "notice": "cookie cookie-notice consent gdpr notice alert banner message cookie-bar privacy-notice paywall announcement popup modal overlay",
    "side": "sidebar side widget related related-posts rail secondary col-right recommended trending most-read teaser-list tags",
    "nav": "menu nav navigation navbar main-menu breadcrumb breadcrumbs pagination toc pager topnav links",
    "header": "header masthead site-header top page-header topbar branding logo",
    "footer": "footer site-footer bottom colophon copyright page-footer legal imprint",
    "comments": "comments comment-list discussion responses reader-comments disqus comments-area replies",
    "form": "search newsletter subscribe signup login contact-form search-form feedback",
    "share": "share social social-share sharing follow buttons toolbar meta-links",
    "main": "content main article post entry post-content entry-content article-body story story-body text body-text page-content main-content single prose markdown",
    "plain": "wrapper container row inner box section block grid col page site layout outer clearfix wrap",
}
_CUES = {
    "comments": ("Comments", "3 Comments", "Leave a reply", "Kommentare", "Commentaires", "Comentarios", "Reply", "Discussion"),
    "side": ("Related", "Most read", "Popular", "Newsletter", "Tags", "Mehr zum Thema", "À lire aussi", "Lo más leído"),
    "notice": ("We use cookies.", "Accept", "This site uses cookies.", "Wir verwenden Cookies.", "Nous utilisons des cookies.", "Usamos cookies.", "Please enable JavaScript."),
    "form": ("Search", "Subscribe", "Email", "Submit", "Name", "Suche", "Send", "Log in", "Password"),
    "ad": ("Advertisement", "Anzeige", "Sponsored", "Publicité", "Publicidad"),
    "footer": ("All rights reserved.", "Privacy", "Terms", "Imprint", "Contact"),
    "share": ("Share", "Tweet", "Print", "Facebook", "Follow us"),
}


class _Maker:
    def __init__(self, rng: random.Random):
        self.rng, self.main = rng, []
        self.onset, self.vowels, self.short = rng.choice(_SCRIPTS)
        self.odd = rng.random()  # texts without sentences, of symbols or of table cells

    def word(self) -> str:
        r = self.rng
        return r.choice(self.short) if r.random() < 0.3 else "".join(r.choice(self.onset) + r.choice(self.vowels) for _ in range(r.choice((1, 1, 2, 2, 3, 4))))

    def words(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(least, most)))

    def sentences(self, least: int = 1, most: int = 6) -> str:
        r, out = self.rng, []
        for _ in range(r.randint(least, most)):
            s = self.words(1, 18)
            if r.random() < 0.3:
                s = s.replace(" ", ", ", 1)
            out.append(s[0].upper() + s[1:] + r.choice("....!?"))
        text = " ".join(out)
        if self.odd < 0.08:
            text = text.replace(" ", r.choice((" | ", "### ", "%%% ", "&&& ", "*** ")))
        elif self.odd < 0.12:
            text = text.replace(".", "").lower()
        elif self.odd < 0.2 and r.random() < 0.3:
            text += f" {r.randint(10**5, 10**15)} {self.word()}@{self.word()}.example"
        return text

    def attrs(self, kind: str) -> str:
        r = self.rng
        name = r.choice(_NAMES[kind].split())
        if r.random() < 0.3:
            name += r.choice((" ", "-", "__")) + r.choice(("left", "large", "item", "wide", "inner", "x1"))
        return r.choice((f' class="{name}"', f' class="{name}"', f" class='{name} {self.word()}'", f' id="{name}"', f' id="{name}" class="{self.word()}"', f' data-x="1>0" class="{name}"'))

    def inline(self, text: str, links: float = 0.2) -> str:
        """Markup of a text: escaped, some words in inline elements, white space and line breaks here and there."""
        r, out = self.rng, []
        for w in text.split(" "):
            w = escape(w, quote=False)
            p = r.random()
            if p < 0.02:
                w = f"<{(t := r.choice(('b', 'em', 'strong', 'i', 'span', 'code')))}>{w}</{t}>"
            elif p < 0.02 + 0.05 * links:
                w = f'<a href="/{r.random()}">{w}</a>'
            out.append(w)
        joint = "\n" if r.random() < 0.1 else " "
        return joint.join(out)

    def own(self, text: str) -> str:
        """A text that belongs to the article."""
        self.main.append(" ".join(text.split()))
        return self.inline(text)

    def link_list(self, kind: str, least: int = 3, most: int = 12) -> str:
        r = self.rng
        long = r.random() < 0.3
        links = [f'<a href="/{i}">{escape(self.words(3, 9) if long else self.words(1, 2))}</a>' for i in range(r.randint(least, most))]
        form = r.random()
        if form < 0.6:
            return f"<ul{self.attrs(kind) if r.random() < 0.3 else ''}>" + "".join(f"<li>{a}{'</li>' if form < 0.5 else ''}" for a in links) + "</ul>"
        return (" | " if form < 0.8 else " ").join(links)

    def cue(self, kind: str, tag: str = "p") -> str:
        return f"<{tag}>{self.rng.choice(_CUES[kind])}</{tag}>"

    def boxed(self, kind: str, inside: str, tags: tuple[str, ...]) -> str:
        tag = self.rng.choice(tags)
        named = tag in ("div", "section", "ul") or self.rng.random() < 0.5
        return f"<{tag}{self.attrs(kind) if named else ''}>{inside}</{tag}>"

    def prose(self, least: int = 1, most: int = 3) -> str:
        text = self.inline(self.sentences(least, most))
        return text if self.rng.random() < 0.5 else f"<p>{text}</p>"

    def ad(self) -> str:
        return self.boxed("ad", (self.cue("ad", "span") if self.rng.random() < 0.3 else "") + (self.prose() if self.rng.random() < 0.8 else self.link_list("ad", 1, 3)), ("div", "div", "aside", "section", "ins"))

    def notice(self) -> str:
        r = self.rng
        role = r.choice(("", "", ' role="alert"', ' role="dialog"', ' aria-hidden="true"'))
        return f"<div{self.attrs('notice')}{role}>{self.cue('notice') if r.random() < 0.5 else ''}{self.prose()}{'<button>' + r.choice(('OK', 'Accept', self.word())) + '</button>' if r.random() < 0.6 else ''}</div>"

    def form(self) -> str:
        r = self.rng
        fields = "".join(f"<label>{r.choice(_CUES['form'])}</label><input name=x>" for _ in range(r.randint(1, 3)))
        more = f"<select><option>{self.word()}<option>{self.word()}</select>" if r.random() < 0.3 else ""
        more += f"<textarea>{self.words(1, 8)}</textarea>" if r.random() < 0.3 else ""
        form = f"<form{self.attrs('form') if r.random() < 0.5 else ''}>{self.prose(1, 2) if r.random() < 0.5 else ''}{fields}{more}<button type=submit>{r.choice(_CUES['form'])}</button></form>"
        return self.boxed("form", form, ("div",)) if r.random() < 0.4 else form

    def share(self) -> str:
        return self.boxed("share", "".join(f'<a href="#">{c}</a> ' for c in self.rng.sample(_CUES["share"], 3)), ("div", "div", "ul"))

    def nav(self) -> str:
        return self.boxed("nav", self.link_list("nav"), ("nav", "nav", "div", "div"))

    def header(self) -> str:
        r = self.rng
        inside = [f'<a href="/">{self.words(1, 3)}</a>', f"<p>{self.inline(self.sentences(1, 1))}</p>", f"<h1>{self.words(1, 3)}</h1>", f"<div{self.attrs('header')}>{self.words(1, 4)}</div>", self.nav(), self.form(), self.prose()]
        return self.boxed("header", "".join(r.sample(inside, r.randint(1, 3))), ("header", "header", "div"))

    def side(self) -> str:
        r, out = self.rng, []
        for _ in range(r.randint(1, 4)):
            head = self.cue("side", r.choice(("h2", "h3", "h4"))) if r.random() < 0.5 else f"<h3>{self.words(1, 4)}</h3>"
            body = r.choice((self.link_list("side"), self.prose(1, 4), self.ad(), self.form(), f"<p>{self.inline(self.sentences(1, 2))}</p>" * 2))
            out.append(self.boxed("side", head + body, ("div", "section")) if r.random() < 0.5 else head + body)
        return self.boxed("side", "".join(out), ("aside", "aside", "div", "div"))

    def footer(self) -> str:
        r = self.rng
        inside = [f"&copy; {self.word()}.example &middot; {self.inline(self.sentences(1, 2))}", self.link_list("footer"), self.cue("footer"), f"<p>&copy; 20{r.randint(10, 26)} {self.words(1, 4)}</p>", self.prose(1, 4), f"<address>{self.words(2, 6)}</address>", self.form()]
        return self.boxed("footer", "".join(r.sample(inside, r.randint(1, 3))), ("footer", "footer", "footer", "div"))

    def comments(self) -> str:
        r, out = self.rng, []
        inner = r.choice(("comment", "reply", "response", self.word()))
        tag = r.choice(("div", "li", "article", "p"))
        for _ in range(r.randint(1, 6)):
            who = r.choice((f"<span class=author>{self.words(1, 2)}</span> ", f"<b>{self.words(1, 2)}</b> ", f"<cite>{self.words(1, 2)}</cite>:", f"<h4>{self.words(1, 2)}</h4>", ""))
            said = self.prose(1, 5) if tag != "p" else self.inline(self.sentences(1, 5))
            out.append(f'<{tag} class="{inner}">{who if tag != "p" else ""}{said}{"<a href=#>Reply</a>" if r.random() < 0.3 else ""}</{tag}>')
        body = "".join(out)
        if tag == "li":
            body = f"<ol>{body}</ol>"
        head = self.cue("comments", r.choice(("h2", "h3", "p"))) if r.random() < 0.6 else ""
        return self.boxed("comments", head + body + (self.form() if r.random() < 0.4 else ""), ("section", "div", "div", "aside"))

    def part(self) -> str:
        """One piece of an article."""
        r, p = self.rng, self.rng.random()
        if p < 0.55:
            return f"<p>{self.own(self.sentences())}</p>"
        if p < 0.62:  # a paragraph that is not closed
            return f"<p>{'<b>' if r.random() < 0.7 else ''}{self.own(self.sentences())}{'<br>' if r.random() < 0.7 else ''}"
        if p < 0.65:
            return f"<p>{self.own(self.words(1, 5).capitalize() + '.')}</p>"
        if p < 0.67:  # words that elsewhere tell a purpose
            return f"<p>{self.own(r.choice([c for cues in _CUES.values() for c in cues]) + r.choice(('', ' ' + self.sentences(1, 2))))}</p>"
        if p < 0.75:
            return f"<{(t := r.choice(('h2', 'h3', 'h4')))}>{self.own(self.words(1, 7).capitalize())}</{t}>"
        if p < 0.81:
            items = "".join(f"<li>{self.own(self.sentences(1, 2) if r.random() < 0.5 else self.words(1, 6))}{'</li>' if r.random() < 0.8 else ''}" for _ in range(r.randint(2, 6)))
            return f"<{(t := r.choice(('ul', 'ol')))}>{items}</{t}>"
        if p < 0.85:
            return f"<blockquote>{'<p>' if r.random() < 0.5 else ''}{self.own(self.sentences(1, 3))}</blockquote>"
        if p < 0.88:
            return f"<pre>{self.own(self.words(3, 20))}</pre>"
        if p < 0.91:
            rows = "".join("<tr>" + "".join(f"<{c}>{self.own(r.choice((self.words(1, 3), str(r.randint(1, 9999)))))}</{c}>" for _ in range(3)) + "</tr>" for c in ("th", "td", "td"))
            return f"<table>{rows}</table>"
        if p < 0.94:
            return f"<figure><img src=x><figcaption>{self.own(self.sentences(1, 1))}</figcaption></figure>"
        return f"<div>{self.own(self.sentences())}</div>"

    def article(self) -> tuple[str, str]:
        """Markup of an article, and its headline."""
        r = self.rng
        headline = r.choice((self.words(2, 10).capitalize(), self.sentences(1, 3)))
        out = []
        if r.random() < 0.85:
            h = f"<{(t := r.choice(('h1', 'h1', 'h1', 'h2')))}{self.attrs('main') if r.random() < 0.2 else ''}>{self.own(headline)}</{t}>"
            out.append(f"<header>{h}</header>" if r.random() < 0.1 else h)
        breaks = r.choice((0, 0, 0.1, 0.2, 0.4))
        for k in range(r.choice((1, 1, 2, 3, 5, 8, 13, 25))):
            out.append(self.part())
            if r.random() < breaks:
                out.append(r.choice((self.ad, self.ad, self.form, self.share, self.side, self.notice, lambda: f"<script>var p='<p>{self.words(3, 9)}</p>';</script>", self.nav))())
        if r.random() < 0.15:
            out.append(r.choice((self.share, self.side, self.nav, self.form, self.ad))())
        if r.random() < 0.12:
            out.append(self.comments())
        return "".join(out), headline

    def page(self) -> tuple[str, str]:
        r = self.rng
        plan = [f() for f in (self.notice, self.header, self.nav, self.ad, self.nav, self.form) if r.random() < 0.35]
        if r.random() < 0.35:
            plan = [self.nav(), "<!-- ad -->", self.ad()]
        body, headline = self.article()
        form = r.random()
        role = r.choice(("", ' role="main"', ' itemprop="articleBody"'))
        if form < 0.35:
            body = f"<article{self.attrs('main') if r.random() < 0.4 else ''}>{body}</article>"
        elif form < 0.5:
            body = f"<main>{body}</main>"
        elif form < 0.62:
            body = f"<main{self.attrs('plain')}><article>{body}</article>{self.comments() if r.random() < 0.3 else ''}</main>"
        elif form < 0.85:
            body = f"<div{self.attrs('main')}{role}>{body}</div>"
        elif form < 0.9:
            body = f"<section{self.attrs('main')}>{body}</section>"
        elif form < 0.93:
            body = f"<table><tr><td>{self.nav()}</td><td{self.attrs('main')}>{body}</td></tr></table>"
        elif form < 0.96:
            body = f"<div{role}>{body}</div>"
        after = [f() for f in (self.share, self.ad, self.side, self.comments, self.nav, self.notice) if r.random() < 0.25]
        if r.random() < 0.2:
            plan.append(self.side())
        if r.random() < 0.4:
            wrap = self.rng.choice((1, 2))
            body = f"<div{self.attrs('plain')}>" * wrap + body + (after.pop() if after and r.random() < 0.5 else "") + "</div>" * wrap
        end = self.footer() if r.random() < 0.8 else ""
        title = escape((headline if r.random() < 0.8 else self.words(2, 6))[: r.choice((20, 60, 200))] + (f" | {self.word()}" if r.random() < 0.3 else ""))
        head = f"<head><meta charset=utf-8><title>{title}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head>" if r.random() < 0.9 else ""
        html = f"{'<!DOCTYPE html>' if r.random() < 0.8 else ''}<html>{head}<body{self.attrs('plain') if r.random() < 0.3 else ''}>" + "".join(plan) + body + "".join(after) + end
        return html + ("</body></html>" if r.random() < 0.85 else ""), " ".join(t for t in self.main if t)


def labelled_pages(n: int, seed: int) -> list[tuple[str, str]]:
    """n pages and their main texts; the same for the same seed.  A few have no article, or are plain text without markup."""
    out = []
    for k in range(n):
        maker = _Maker(random.Random(f"{seed}:{k}"))
        if k % 40 == 7:
            text = maker.sentences(2, 12)
            out.append((escape(text), " ".join(text.split())))
        elif k % 40 == 23:
            out.append((f"<html><body>{maker.nav()}{maker.ad()}{maker.footer()}</body></html>", ""))
        else:
            out.append(maker.page())
    return out
