"""Invented pages with known main text, in many layouts, to train and test the extraction on."""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

SYLLABLES = "an be co de el fi go ha in ja ko lu mo na or pe qua re sa ti un va wi yo zu che thi stra".split()
WRAPPERS = {
    "nav": ["nav", "menu", "navbar", "main-nav", "site-navigation", "topnav", "breadcrumbs", "pagination"],
    "header": ["header", "site-header", "masthead", "page-top", "branding"],
    "footer": ["footer", "site-footer", "page-bottom", "copyright", "legal"],
    "aside": ["sidebar", "side", "related", "widget", "right-rail", "recommended", "popular-posts"],
    "ad": ["ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "ad-slot"],
    "notice": ["cookie-notice", "cookie", "consent", "notice", "alert", "popup", "gdpr-banner", "modal"],
    "form": ["newsletter", "subscribe", "search-form", "login", "contact-form"],
    "comments": ["comments", "comment-list", "discussion", "replies", "responses comments-area"],
    "share": ["share", "social", "share-buttons", "byline", "meta"],
    "main": ["content", "post", "entry-content", "article-body", "story", "main-content", "post-text", "page-content"],
}


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.mains: set[str] = set()
        #: On some pages names say nothing, and the tags that would are not used.
        self.silent = {k: f"{self.r.choice(['css', 'x', 'sc', ''])}-{self.word()}{self.r.randint(0, 99)}" for k in WRAPPERS} if self.r.random() < 0.4 else {}

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        s = self.phrase(3, 18).capitalize()
        if self.r.random() < 0.1:
            s += self.r.choice([" & co", " < 5", ' "so"', " – ja", " #1", " $5"])
        return s + self.r.choice("....!?")

    def paragraph(self, most: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(1, most)))

    def shown(self, text: str) -> str:
        return html.escape(text, quote=self.r.random() < 0.5)

    def main(self, text: str) -> str:
        self.mains.add(text)
        return self.shown(text)

    def hint(self, kind: str) -> str:
        if self.silent:
            return f' class="{self.silent[kind]}"'
        name = self.r.choice(WRAPPERS[kind])
        return f' {self.r.choice(["class", "class", "id"])}="{name}"' if self.r.random() < 0.95 else f' class="{name} {self.word()}" id="{self.word()}"'

    def boxed(self, kind: str, tag: str, inner: str) -> str:
        if tag and self.r.random() < (0.15 if self.silent else 0.55):
            return f"<{tag}{self.hint(kind) if self.r.random() < 0.4 else ''}>{inner}</{tag}>"
        outer = self.r.choice(["div", "div", "section"])
        return f"<{outer}{self.hint(kind)}>{inner}</{outer}>"

    def links(self, low: int, high: int) -> str:
        rows = [f'<a href="/{self.word()}">{self.shown(self.phrase(1, 4))}</a>' for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}" + "</li>" * (self.r.random() < 0.9) for x in rows) + "</ul>"
        return self.r.choice([" | ", " ", "<br>"]).join(rows)

    def plain(self) -> str:
        """Text without hints or links, as boxes outside the article hold it; links where names say nothing."""
        text = self.shown(self.paragraph(3))
        if self.silent:
            text = f'<a href="/{self.word()}">{text}</a>'
        return f"<p>{text}</p>" if self.r.random() < 0.4 else text

    def box(self, kind: str) -> str:
        if kind == "nav":
            return self.boxed("nav", "nav", self.links(2, 9))
        if kind == "header":
            return self.boxed("header", "header", self.r.choice(["", f"<h1>{self.shown(self.phrase(1, 3))}</h1>", f"<div>{self.shown(self.phrase(1, 5))}</div>"]) + (self.links(2, 5) if self.r.random() < 0.5 else self.plain()))
        if kind == "footer":
            inner = f"&copy; {self.word()}.example.com &middot; {self.shown(self.sentence())}" if self.r.random() < 0.5 else self.plain()
            return self.boxed("footer", "footer", inner + (self.links(1, 5) if self.r.random() < 0.4 else ""))
        if kind == "aside":
            inner = (f"<h3>{self.shown(self.phrase(1, 3))}</h3>" if self.r.random() < 0.6 else "") + (self.links(2, 7) if self.r.random() < 0.6 else self.plain())
            return self.boxed("aside", "aside", inner)
        if kind in ("ad", "notice", "share"):
            inner = self.plain() if kind != "share" or self.r.random() < 0.4 else self.links(2, 4)
            return self.boxed(kind, "aside" if kind == "ad" and self.r.random() < 0.2 else "", inner + ("<button>OK</button>" if kind == "notice" and self.r.random() < 0.6 else ""))
        if kind == "form":
            inner = f"<label>{self.shown(self.phrase(1, 3))}</label><input name=q><button>{self.word()}</button>"
            return f"<form{self.hint('form') if self.r.random() < 0.5 else ''}>{self.plain() if self.r.random() < 0.5 else ''}{inner}</form>"
        rows = []
        for _ in range(self.r.randint(1, 6)):
            text = f"<p>{self.shown(self.paragraph(4))}</p>" if self.r.random() < 0.7 else self.shown(self.paragraph(3))
            who = f"<b>{self.word()}</b> " if self.r.random() < 0.3 else f"<h4>{self.word()}</h4>" if self.r.random() < 0.3 else ""
            tag = self.r.choice(["div", "li", "div", "article"])
            rows.append(f'<{tag} class="{self.r.choice(["comment", "reply", "comment-body"])}">{who}{text}</{tag}>' if self.r.random() < 0.7 and not self.silent else f"<{tag}>{who}{text}</{tag}>")
        if self.r.random() < 0.4:
            rows.append(f"<form><textarea></textarea><button>{self.word()}</button></form>")
        return f"<{(t := self.r.choice(['section', 'div', 'ol', 'ul']))}{self.hint('comments')}>" + (f"<h3>{self.shown(self.phrase(1, 3))}</h3>" if self.r.random() < 0.6 else "") + "".join(rows) + f"</{t}>"

    def body(self) -> str:
        out, r = [], self.r
        title = self.phrase(2, 12).capitalize()
        if r.random() < 0.85:
            out.append(f"<h1>{self.main(title)}</h1>")
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12, 20])):
            x = r.random()
            if x < 0.62:
                text = self.main(self.paragraph(r.choice([1, 2, 4, 8])))
                if r.random() < 0.15:
                    first, _, rest = text.partition(" ")
                    text = f'<a href="/{self.word()}">{first}</a> {rest}' if "&" not in first else text
                out.append(f"<p>{text}" + "</p>" * (r.random() < 0.9))
            elif x < 0.7:
                out.append(f"<p><b>{self.main(self.paragraph(3))}<br>" + (f"<p>{self.main(self.sentence())}</p>" if r.random() < 0.7 else "</b></p>"))
            elif x < 0.76:
                out.append(f"<h2>{self.main(self.phrase(1, 6).capitalize())}</h2>")
            elif x < 0.83:
                tag, whole, end = r.choice(["ul", "ol"]), r.random() < 0.5, "</li>" * (r.random() < 0.7)
                out.append(f"<{tag}>" + "".join(f"<li>{self.main(self.paragraph(2) if whole else self.phrase(2, 12))}{end}" for _ in range(r.randint(2, 6))) + f"</{tag}>")
            elif x < 0.86:
                out.append(f"<blockquote>{self.main(self.paragraph(2))}</blockquote>" if r.random() < 0.5 else f"<pre>{self.main(self.phrase(3, 9))}</pre>")
            elif x < 0.89:
                out.append("<table>" + "".join(f"<tr><td>{self.main(self.phrase(1, 3))}</td><td>{self.main(self.phrase(1, 4))}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif x < 0.92:
                out.append(f"<div>{self.main(self.paragraph(4))}</div>")
            elif x < 0.94:
                out.append("<dl>" + "".join(f"<dt>{self.main(self.phrase(1, 3))}<dd>{self.main(self.paragraph(2))}" for _ in range(r.randint(1, 4))) + "</dl>")
            elif x < 0.955:
                out.append(f"<figure><img src=x.jpg><figcaption>{self.main(self.sentence())}</figcaption></figure>")
            else:
                out.append(self.box(r.choice(["ad", "ad", "share", "form", "notice", "aside"])))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        before = [self.box(k) for k in ("header", "nav", "notice", "ad", "form", "aside") if r.random() < {"nav": 0.8, "ad": 0.5}.get(k, 0.3)]
        after = [self.box(k) for k in ("share", "comments", "aside", "ad", "nav", "notice") if r.random() < {"comments": 0.4, "aside": 0.4}.get(k, 0.2)]
        if r.random() < 0.9:
            after.append(self.box("footer"))
        inner = self.body()
        if r.random() < 0.15:
            inner += self.box("comments")
        x = r.random()
        if x < 0.45:
            inner = f"<article{self.hint('main') if r.random() < 0.3 else ''}>{inner}</article>"
        elif x < 0.6:
            inner = f"<main>{inner}</main>" if r.random() < 0.5 else f"<main><article>{inner}</article></main>"
        elif x < 0.85:
            inner = f"<div{self.hint('main')}>{inner}</div>"
        elif x < 0.93:
            inner = f"<div>{inner}</div>"
        if r.random() < 0.08:
            return f"<html><body><table><tr><td>{''.join(before)}<td>{inner}<td>{''.join(after)}</table>"
        if r.random() < 0.25:
            inner = f'<div class="{r.choice(["wrapper", "container", "row", "page", self.word()])}">{inner}{self.box("aside") if r.random() < 0.4 else ""}</div>'
        if r.random() < 0.2:
            before, after = ["".join(before)], after
        comment = f"<!-- {self.word()} -->" if r.random() < 0.5 else ""
        script = f'<script>var {self.word()}="</p>";</script>' if r.random() < 0.6 else ""
        end = "</body></html>" if r.random() < 0.8 else ""
        return f"<!DOCTYPE html><html><head><title>{self.shown(self.phrase(2, 6))}</title><style>p{{margin:0}}</style>{script}</head><body>{''.join(before)}{comment}{inner}{''.join(after)}{end}"


def made_pages(n: int, seed: int) -> Iterator[tuple[str, set[str]]]:
    """n pages with the texts of their main blocks."""
    for k in range(n):
        maker = Maker(seed * 1_000_003 + k)
        yield maker.page(), maker.mains
