"""Pages of layouts and wordings that the training pages don't have, with the texts of their main blocks in order."""

import random

WORDS = "der die und haus river stone market garden Wetter évasion später council budget players winter recipe flour engine module release train harbour señal ciudad montagne vote school".split()
#: What boxes are called in each family of layouts: menu, head, foot, side, advert, notice, comments, content.
NAMES = {
    "german": ["hauptmenue", "kopfzeile", "fusszeile", "seitenleiste", "werbung", "hinweis", "kommentare", "inhalt"],
    "hashed": ["css-1x9ab", "css-k2m4z", "sc-bdVaJa", "css-77fhq", "sc-htpNat", "css-0oi1u", "sc-kAzzGY", "css-9zz1p"],
    "bem": ["c-nav__list", "l-header__inner", "l-footer", "l-sidebar--right", "c-ad-slot--mpu", "c-cookie-bar", "c-comments__thread", "c-article__body"],
    "press": ["menu-main-container", "site-branding", "site-info", "widget-area", "adsbygoogle", "cookie-law-info-bar", "comments-area", "entry-content"],
    "plain": ["m", "t", "b", "r", "x1", "x2", "k", "c"],
    "docs": ["toctree-wrapper", "topbar", "rst-footer-buttons", "sphinxsidebar", "sponsor", "admonition-banner", "giscus", "document"],
}


class Other:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(f"other {seed}")
        self.main: list[str] = []
        self.family = self.r.choice(list(NAMES))
        self.names = dict(zip(("menu", "head", "foot", "side", "ad", "notice", "talk", "content"), NAMES[self.family], strict=True))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.r.choices(WORDS, k=self.r.randint(low, high)))

    def prose(self, most: int) -> str:
        return " ".join(self.words(6, 16).capitalize() + self.r.choice(".." "?!") for _ in range(self.r.randint(1, most)))

    def kept(self, text: str) -> str:
        self.main.append(text)
        return text

    def box(self, kind: str, inner: str, tag: str = "div") -> str:
        return f'<{tag} class="{self.names[kind]}">{inner}</{tag}>'

    def links(self, n: int) -> str:
        items = [f'<a href="#{k}">{self.words(1, 3)}</a>' for k in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.6 else " &middot; ".join(items)

    def around(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            return self.box("menu", self.links(r.randint(4, 9)))
        if kind == "head":
            return self.box("head", f'<a href="/">{self.words(1, 2)}</a> <span>{self.words(2, 5)}</span>')
        if kind == "foot":
            return self.box("foot", f"&copy; 2024 {self.words(1, 3)}. {self.links(3)}")
        if kind == "side":
            return self.box("side", f"<h4>{self.words(1, 3)}</h4>{self.links(r.randint(3, 6))}")
        if kind == "ad":
            return self.box("ad", f'<a href="//ads.example/{r.randint(1, 99)}">{self.words(3, 8)}</a>')
        if kind == "notice":
            return self.box("notice", f"{self.words(6, 12)} <button>OK</button>")
        rows = "".join(f"<li><b>{self.words(1, 2)}</b><p>{self.prose(2)}</p></li>" for _ in range(r.randint(1, 4)))
        return self.box("talk", f"<h3>{r.randint(1, 4)} Kommentare</h3><ol>{rows}</ol><form><textarea></textarea><button>ok</button></form>")

    def content(self) -> str:
        r, out = self.r, [f"<h1>{self.kept(self.words(3, 8).capitalize())}</h1>"]
        for _ in range(r.randint(2, 9)):
            x = r.random()
            if x < 0.6:
                out.append(f"<p>{self.kept(self.prose(5))}</p>")
            elif x < 0.7:
                out.append(f"<h2>{self.kept(self.words(2, 5).capitalize())}</h2><p>{self.kept(self.prose(4))}</p>")
            elif x < 0.78:
                out.append("<dl>" + "".join(f"<dt>{self.kept(self.words(1, 2))}<dd>{self.kept(self.prose(1))}" for _ in range(2)) + "</dl>")
            elif x < 0.86:
                out.append(f"<figure><img src=a.png><figcaption>{self.kept(self.prose(1))}</figcaption></figure>")
            elif x < 0.93:
                out.append("<ol>" + "".join(f"<li>{self.kept(self.prose(1))}" for _ in range(3)) + "</ol>")
            else:
                out.append(self.around("ad"))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        top = [self.around(k) for k in ("notice", "head", "menu") if r.random() < 0.8]
        inner = self.box("content", self.content(), r.choice(["div", "div", "section", "main"]))
        end = [self.around(k) for k in ("talk", "side", "ad", "foot") if r.random() < 0.6]
        if self.family == "plain" and r.random() < 0.7:  # three columns of a table
            body = f"<table><tr><td>{''.join(top)}</td><td>{inner}</td><td>{''.join(end)}</td></tr></table>"
        elif self.family == "press" and r.random() < 0.5:  # comments inside the article
            body = f"{''.join(top)}<article>{inner}{''.join(end[:1])}</article>{''.join(end[1:])}"
        else:
            body = "".join(top) + f'<div class="{self.family}-wrap">{inner}</div>' + "".join(end)
        return f"<html><head><title>{self.words(2, 4)}</title></head><body>{body}</body></html>"


def other_pages(n: int, seed: int):
    for k in range(n):
        maker = Other(seed * 100_003 + k)
        yield maker.family, maker.page(), maker.main
