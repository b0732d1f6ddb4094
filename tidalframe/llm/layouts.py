"""Pages with known main text to fit ``extract`` on: texts of the given pages, laid out in many ways.

What is written into a page here is named as page authors name it; the marks of
the main text are characters that no page holds, taken off again when read.
"""

from __future__ import annotations

import html
import random
from collections.abc import Callable

#: Stands in front of a block of main text.
MARK = "\ue000"

#: What authors call the parts of a page (fixed values).
MAIN = "article post entry content story body text main page-content post-body entry-content article-body story-content markdown prose blog-post hentry".split()
WRAPS = "wrapper container row inner outer page site layout grid col-md-8 columns wrap holder box section-1 root app css-1x2y block".split()
MENU = "nav menu navbar main-nav navigation breadcrumb breadcrumbs topbar site-nav menu-list tabs pagination skip-links toc-nav".split()
HEAD = "header masthead site-header banner top-header branding page-header logo".split()
FOOT = "footer site-footer bottom colophon copyright legal footer-links".split()
SIDE = "sidebar aside widget related recommended trending popular most-read more-stories secondary rail teaser tags social share author-box newsletter-box".split()
AD = "ad ads advert advertisement sponsored promo sponsor banner-ad ad-slot adsbygoogle commercial".split()
NOTE = "cookie cookie-banner notice alert gdpr consent popup modal overlay paywall disclaimer notification message-bar".split()
FORM = "form search newsletter subscribe login signup contact-form comment-form".split()
TALK = "comments comment-list comment reply replies respond discussion disqus user-comments reactions feedback".split()


class Layout:
    """One page, random in everything but which texts are main."""

    def __init__(self, rng: random.Random, pieces: list[str]):
        self.rng, self.pieces = rng, pieces
        # Some pages name parts by elements alone, some by attributes alone.
        self.semantic, self.named = rng.random() < 0.6, rng.random() < 0.85
        self.loose = rng.random() < 0.25

    def text(self, least: int = 1, most: int = 10**9) -> str:
        piece = self.rng.choice(self.pieces)
        words = piece.split()
        if len(words) < least:
            words += self.rng.choice(self.pieces).split()
        if len(words) > most:
            at = self.rng.randrange(len(words) - most + 1)
            words = words[at : at + most]
        return html.escape(" ".join(words), quote=False)

    def element(self, tags: str, names: list[str], inner: str, always: bool = False) -> str:
        rng = self.rng
        semantic, _, plain = tags.partition("|")
        tag = rng.choice(semantic.split()) if self.semantic or not plain else rng.choice(plain.split())
        attributes = ""
        if self.named and (always or rng.random() < 0.85) or (plain and tag in plain.split() and rng.random() < 0.9):
            name = rng.choice(names)
            if rng.random() < 0.3:
                name += rng.choice(["", "-", "_", " "]) + rng.choice(["area", "wrap", "item", "box", "inner", "container", "1", "section"])
            if rng.random() < 0.15:
                first, *rest = name.replace("_", "-").split("-")
                name = first + "".join(w.capitalize() for w in rest)
            attributes = f' {rng.choice(["class", "class", "class", "id"])}="{name}"'
        if rng.random() < 0.08:
            attributes += f' data-x="{rng.randrange(99)}"'
        if rng.random() < 0.02:
            tag = tag.upper()
        return f"<{tag}{attributes}>{inner}" + ("" if self.loose and tag in ("p", "li") and rng.random() < 0.5 else f"</{tag}>")

    def some(self, f: Callable[[], str], least: int, most: int) -> str:
        return "".join(f() for _ in range(self.rng.randint(least, most)))

    def link(self, most: int = 6) -> str:
        return f'<a href="/{self.rng.randrange(999)}">{self.text(1, self.rng.randint(1, most))}</a>'

    def links(self, most: int = 6) -> str:
        if self.rng.random() < 0.7:
            return "<ul>" + self.some(lambda: f"<li>{self.link(most)}</li>", 2, 9) + "</ul>"
        return self.some(lambda: self.rng.choice(["<div>", "<p>", "<span>"]) + self.link(most) + " ", 2, 9)

    def menu(self) -> str:
        return self.element("nav|div ul", MENU, self.links(3))

    def form(self) -> str:
        return self.element("form", FORM, f"<label>{self.text(1, 3)}</label><input type=text>" + (f"<p>{self.text(3, 14)}</p>" if self.rng.random() < 0.5 else "") + "<button>ok</button>")

    def ad(self) -> str:
        return self.element("div aside|div", AD, self.rng.choice([self.text(2, 20), f"<p>{self.text(2, 20)}</p>{self.link()}", self.link(8)]), always=True)

    def note(self) -> str:
        return self.element("div aside section|div", NOTE, f"<p>{self.text(4, 30)}</p>" + self.rng.choice(["", self.link(2), "<button>x</button>"]), always=True)

    def header(self) -> str:
        inner = [self.element("div a p", HEAD, self.text(1, 4)), self.menu(), self.form() if self.rng.random() < 0.4 else "", self.ad() if self.rng.random() < 0.2 else ""]
        return self.element("header|div", HEAD, "".join(inner[: self.rng.randint(1, 4)]))

    def footer(self) -> str:
        inner = self.rng.choice([lambda: f"&copy; {self.text(1, 8)}", lambda: self.links(3) + f"<p>&copy; {self.text(2, 15)}</p>", lambda: f"<p>{self.text(4, 40)}</p>", lambda: f"example.com &middot; {self.text(2, 12)}"])()
        return self.element("footer|div", FOOT, inner)

    def side(self) -> str:
        widget = lambda: self.element("div section|div", SIDE, f"<h3>{self.text(1, 4)}</h3>" + self.rng.choice([lambda: self.links(8), lambda: f"<p>{self.text(6, 30)}</p>", lambda: self.links(5) + self.ad()])())
        return self.element("aside|div", SIDE, self.some(widget, 1, 4))

    def talk(self) -> str:
        one = lambda: self.element("li div article|li div", TALK, self.rng.choice([f"<b>{self.text(1, 2)}</b> ", f"<div>{self.text(1, 2)}</div>", ""]) + self.some(lambda: f"<p>{self.text(3, 80)}</p>", 1, 3) + self.rng.choice(["", self.link(1)]), always=True)
        inner = f"<{(h := self.rng.choice(['h2', 'h3', 'h4']))}>{self.rng.choice(['Comments', '3 Comments', 'Kommentare', 'Commentaires', self.text(1, 3)])}</{h}>" + self.some(one, 1, 6)
        return self.element("section div|div", TALK, inner + (self.form() if self.rng.random() < 0.4 else ""), always=True)

    def block(self) -> str:
        """A block of main text."""
        rng, inline = self.rng, self.rng.random()
        text = MARK + self.text(1, rng.choice([4, 30, 80, 200]))
        if inline < 0.25:
            text = f"<b>{text}" + ("" if self.loose else "</b>") + rng.choice(["", "<br>"])
        elif inline < 0.4:
            text += " " + self.link(3) + "."
        kind = rng.random()
        if kind < 0.72:
            return f"<p>{text}" + ("" if self.loose and rng.random() < 0.5 else "</p>")
        if kind < 0.78:
            return f"<h{(n := rng.choice('2234'))}>{MARK}{self.text(1, 8)}</h{n}>"
        if kind < 0.84:
            return "<ul>" + self.some(lambda: f"<li>{MARK}{self.text(2, 25)}</li>", 2, 5) + "</ul>"
        if kind < 0.88:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.91:
            return "<table>" + self.some(lambda: f"<tr><td>{MARK}{self.text(1, 4)}</td><td>{MARK}{self.text(1, 4)}</td></tr>", 1, 4) + "</table>"
        if kind < 0.94:
            return f"<figure><img src=x><figcaption>{MARK}{self.text(2, 15)}</figcaption></figure>"
        return f"<{(t := rng.choice(['div', 'section', 'pre']))}>{text}</{t}>"

    def main(self) -> str:
        rng = self.rng
        inner = []
        for _ in range(rng.choice([1, 2, 4, 8, 12])):
            inner.append(self.block())
            if rng.random() < 0.12:
                inner.append(rng.choice([self.ad, self.ad, self.side, self.form, self.note])())
        title = f"<h1>{MARK}{self.text(1, 12)}</h1>"
        title = rng.choice([title, title, f"<header>{title}</header>", ""])
        body = "".join(inner)
        if rng.random() < 0.3:
            body = self.element("div", MAIN, body)
        if rng.random() < 0.2:
            body += rng.choice([self.side, self.talk])()
        out = self.element("article article main|div section td", MAIN, title + body, always=not self.semantic)
        return f"<main>{out}</main>" if self.semantic and rng.random() < 0.3 else out

    def page(self) -> str:
        rng = self.rng
        if rng.random() < 0.06:  # a bare text
            return rng.choice(["", "<html><body>"]) + self.some(self.block, 1, 6)
        parts = [f(self) for f, p in ((Layout.note, 0.2), (Layout.header, 0.6), (Layout.menu, 0.5), (Layout.ad, 0.4)) if rng.random() < p]
        column = [self.main()] + [f(self) for f, p in ((Layout.talk, 0.35), (Layout.ad, 0.15), (Layout.form, 0.15)) if rng.random() < p]
        if rng.random() < 0.5:
            column.insert(rng.randrange(len(column) + 1), self.side())
        inner = "".join(column)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            inner = self.element("div", WRAPS, inner)
        parts.append(inner)
        parts += [f(self) for f, p in ((Layout.footer, 0.8), (Layout.note, 0.1)) if rng.random() < p]
        body = "".join(parts)
        body = f"<body>{body}" + ("" if rng.random() < 0.2 else "</body></html>")
        return f'<!DOCTYPE html><html><head><title>{self.text(2, 9)}</title><style>p{{margin:0}}</style></head>{body}'


def pages(pieces: list[str], n: int, seed: int = 7) -> list[str]:
    rng = random.Random(seed)
    return [Layout(rng, pieces).page() for _ in range(n)]
