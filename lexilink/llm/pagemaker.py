"""Generated web pages with known main text, to train and test the block labeller on.

A page is made of parts in a random but plausible order; each part has one of many usual ways to be marked up. Texts are invented words of random alphabets, so that
labels can't hang on a vocabulary; boilerplate may repeat sentences of the article.
"""

from __future__ import annotations

import html
import re

import numpy as np

from lexilink.llm.htmlblocks import Block, blocks

#: How each part of a page may be wrapped: (start, end).
ARTICLE = [
    ("<article>", "</article>"), ("<article class='post'>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), ("<div class='content'>", "</div>"),
    ("<div id=\"main-content\">", "</div>"), ("<div class='article-body'>", "</div>"), ("<div class='entry-content'>", "</div>"), ("<section class='story text'>", "</section>"),
    ("<div class='post-body'>", "</div>"), ("<div role='main'>", "</div>"), ("<div id='page'><div class='text'>", "</div></div>"), ("<div itemprop='articleBody'>", "</div>"),
    ("<article><header>", "</header>@</article>"),
]
MENU = [("<nav><ul>", "</ul></nav>"), ("<nav class='navbar'>", "</nav>"), ("<div class='menu'><ul>", "</ul></div>"), ("<ul id='nav'>", "</ul>"), ("<div role='navigation'><ul>", "</ul></div>"), ("<div class='breadcrumb'>", "</div>"), ("<menu>", "</menu>")]
HEADER = [("<header>", "</header>"), ("<div class='header'>", "</div>"), ("<div id='masthead'>", "</div>"), ("<header class='site-header top'>", "</header>"), ("<div class='banner logo'>", "</div>")]
FOOTER = [("<footer>", "</footer>"), ("<div class='footer'>", "</div>"), ("<div id='footer'><p>", "</p></div>"), ("<footer class='site'>", "</footer>"), ("<div class='copyright'>", "</div>")]
SIDE = [("<aside>", "</aside>"), ("<div class='sidebar'>", "</div>"), ("<div id='sidebar-right'>", "</div>"), ("<aside class='related'>", "</aside>"), ("<div class='widget'>", "</div>"), ("<section class='recommended more'>", "</section>"), ("<div class='share social'>", "</div>")]
NOTICE = [("<div class='cookie-notice'>", "</div>"), ("<div id='consent'>", "</div>"), ("<div class='notice'>", "</div>"), ("<div role='alert'>", "</div>"), ("<div class='popup modal'>", "</div>"), ("<div class='newsletter'>", "</div>"), ("<p class='notice'>", "</p>"), ("<dialog>", "</dialog>"), ("<section class='gdpr banner'>", "</section>")]
ADVERT = [("<div class='ad'>", "</div>"), ("<div class='advert'>", "</div>"), ("<div id='ads-top'>", "</div>"), ("<ins class='adsbygoogle'><div class='ad'>", "</div></ins>"), ("<div class='sponsored promo'>", "</div>"), ("<aside class='ad'>", "</aside>"), ("<p class='advertisement'>", "</p>")]
FORM = [("<form>", "</form>"), ("<form class='search'>", "</form>"), ("<form id='login'><fieldset>", "</fieldset></form>"), ("<div class='contact'><form>", "</form></div>")]
COMMENTS = [("<section class='comments'>", "</section>"), ("<div id='comments'>", "</div>"), ("<div class='comment-list'><ol>", "</ol></div>"), ("<section id='disqus comments'>", "</section>"), ("<div class='replies'>", "</div>"), ("<ul class='comments'>", "</ul>")]
HIDDEN = ["<script>var a='<p>no text</p>';</script>", "<style>p{margin:0}</style>", "<!-- <p>not here</p> -->", "<noscript>turn it on</noscript>"]


class Maker:
    def __init__(self, rng: np.random.Generator):
        self.rng = rng
        letters = list("abcdefghijklmnopqrstuvwxyz") + list("éèäöüßñçáó") * int(rng.integers(0, 2))
        self.syllables = ["".join(rng.choice(letters, int(rng.integers(1, 4)))) for _ in range(60)]
        self.used: list[str] = []

    def pick(self, options):
        return options[int(self.rng.integers(0, len(options)))]

    def words(self, least: int, most: int) -> str:
        return " ".join("".join(self.rng.choice(self.syllables, int(self.rng.integers(1, 4)))) for _ in range(int(self.rng.integers(least, most + 1))))

    def sentence(self, least: int = 3, most: int = 18) -> str:
        text = self.words(least, most).capitalize() + self.pick([".", ".", ".", "!", "?", ""])
        self.used.append(text)
        return text

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(int(self.rng.integers(1, most + 1))))

    def inline(self, text: str) -> str:
        text = html.escape(text, quote=bool(self.rng.integers(0, 2)))
        if self.rng.random() < 0.15:
            at = text.find(" ", len(text) // 2)
            if at > 0:
                tag = self.pick(["b", "i", "em", "a href='/x'", "span", "strong", "code"])
                text = f"{text[:at]} <{tag}>{text[at + 1 :]}" + ("" if self.rng.random() < 0.2 else f"</{tag.split()[0]}>")
        return text

    def article(self) -> str:
        out = [f"<h1>{self.inline(self.sentence(2, 10))}</h1>"] if self.rng.random() < 0.8 else []
        for _ in range(int(self.rng.integers(1, 14))):
            kind = self.rng.random()
            if kind < 0.72:
                close = "" if self.rng.random() < 0.15 else "</p>"
                out.append(f"<p>{self.inline(self.prose(6 if self.rng.random() < 0.8 else 1))}" + self.pick(["", "", "", "<br>"]) + close)
            elif kind < 0.80:
                out.append(f"<{(h := self.pick(['h2', 'h3', 'h4']))}>{self.inline(self.sentence(1, 7))}</{h}>")
            elif kind < 0.87:
                out.append("<ul>" + "".join(f"<li>{self.inline(self.sentence(1, 14))}</li>" for _ in range(int(self.rng.integers(2, 6)))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote><p>{self.inline(self.prose(2))}</p></blockquote>")
            elif kind < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.975:
                out.append(f"<pre>{self.words(3, 12)}</pre>")
            else:
                out.append(f"<figure><figcaption>{self.inline(self.sentence())}</figcaption></figure>")
        return "".join(out)

    def filler(self) -> str:
        """A sentence or two, at times one that the article has too."""
        if self.used and self.rng.random() < 0.3:
            return html.escape(" ".join(self.pick(self.used) for _ in range(int(self.rng.integers(1, 4)))))
        return html.escape(self.prose(2))

    def links(self, listed: bool) -> str:
        item = (lambda t: f"<li><a href='/{t}'>{t}</a></li>") if listed else (lambda t: f"<a href='/{t}'>{t}</a> ")
        return "".join(item(self.words(1, 3)) for _ in range(int(self.rng.integers(2, 9))))

    def part(self, kind: str) -> str:
        start, end = self.pick({"menu": MENU, "header": HEADER, "footer": FOOTER, "side": SIDE, "notice": NOTICE, "advert": ADVERT, "form": FORM, "comments": COMMENTS}[kind])
        if kind == "menu":
            inner = self.links("<ul" in start or "<menu" in start)
        elif kind == "header":
            inner = self.pick([f"<h1>{self.words(1, 4)}</h1>", f"<p>{self.filler()}</p>", f"<a href='/'>{self.words(1, 3)}</a>"]) + (self.part("menu") if self.rng.random() < 0.3 else "")
        elif kind == "footer":
            inner = self.pick(["&copy; ", "", "<small>"]) + self.filler() + self.pick(["", " &middot; " + self.words(1, 4)]) + (f"<p>{self.filler()}" if self.rng.random() < 0.3 else "")
        elif kind == "side":
            inner = f"<h3>{self.words(1, 4)}</h3>" + self.pick([f"<ul>{self.links(True)}</ul>", f"<p>{self.filler()}</p>", f"<p>{self.filler()}</p><p>{self.filler()}</p>"])
        elif kind == "form":
            inner = f"<label>{self.words(1, 3)}</label><input name='q'><p>{self.filler()}</p><button>{self.words(1, 2)}</button>"
        elif kind == "comments":
            inner = f"<h2>{self.words(1, 3)}</h2>" + "".join(self.pick([f"<div class='comment'><p>{self.filler()}</p></div>", f"<p>{self.filler()}</p>", f"<li>{self.filler()}</li>"]) for _ in range(int(self.rng.integers(1, 6))))
        else:
            inner = self.pick([self.filler(), f"<p>{self.filler()}</p>", f"<h4>{self.words(1, 4)}</h4><p>{self.filler()}</p>", f"<p>{self.filler()}</p><a href='/y'>{self.words(1, 2)}</a>"])
        return start + inner + end


def make_page(rng: np.random.Generator) -> str:
    """HTML whose main text stands between two marks, which parse() takes out."""
    m = Maker(rng)
    body = m.article()
    start, end = m.pick(ARTICLE)
    if "@" in end:
        head, _, body_rest = body.partition("</h1>")
        main = start + (head + "</h1>" if body_rest else "") + end.replace("@", body_rest or body)
    else:
        if rng.random() < 0.25:
            cut = body.find("<p>", len(body) // 2)
            if cut > 0:
                # Something foreign inside the article.
                body = body[:cut] + "\ue001" + m.part(m.pick(["advert", "side", "notice", "form"])) + "\ue000" + body[cut:]
        main = start + body + end
    before = [k for k in ("menu", "header", "menu", "notice", "advert", "side", "form") if rng.random() < 0.4]
    after = [k for k in ("comments", "side", "advert", "form", "menu", "notice") if rng.random() < 0.35]
    rng.shuffle(before)
    rng.shuffle(after)
    if rng.random() < 0.85:
        after.append("footer")
    joined = [m.part(k) for k in before] + ["\ue000" + main + "\ue001"] + [m.part(k) for k in after]
    for _ in range(int(rng.integers(0, 3))):
        joined.insert(int(rng.integers(0, len(joined) + 1)), m.pick(HIDDEN))
    wrap = m.pick([("", ""), ("<div id='wrapper'>", "</div>"), ("<div class='page container'>", "</div>")])
    page = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{m.words(2, 6)}</title><style>p{{}}</style></head><body>{wrap[0]}{''.join(joined)}{wrap[1]}</body></html>"
    return page[: len(page) - int(rng.integers(0, 16))] if rng.random() < 0.1 else page


def make_pages(n: int, seed: int) -> list[tuple[list[Block], np.ndarray, str]]:
    """(blocks, is main text, html) of n pages."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        marked = make_page(rng)
        # Labels come from parsing the page with each text piece told apart by where it stands.
        inside, pieces = False, []
        for piece in re.split("(\ue000|\ue001|<[^>]*>)", marked):
            if piece == "\ue000":
                inside = True
            elif piece == "\ue001":
                inside = False
            else:
                pieces.append("\ue002" + piece if inside and piece and not piece.startswith("<") and piece.strip() else piece)
        told = blocks("".join(pieces))
        labels = np.array(["\ue002" in b.text for b in told])
        page = re.sub("[\ue000\ue001]", "", marked)
        found = blocks(page)
        if len(found) == len(told):
            out.append((found, labels, page))
    return out
