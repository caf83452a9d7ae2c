"""Main text of HTML pages: gradient-boosted trees over the features of block elements, decoded as a hierarchy.

The trees are trained here, on pages that page_maker writes with known main text. An element's log-odds of being
part of the main text, or above it, are summed down the page's tree: an element is only kept with its parent, and
only if it and what is best kept below it come to more than nothing. So no kept element lies in a dropped one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees
from .dom import Page
from .page_maker import made_pages

#: Pages that the trees are trained on.
TRAINING_PAGES = 1200
#: Words of class, id and role attributes, by what they hint at.
HINTS = [
    ("nav", "nav navbar navigation menu menus topnav subnav breadcrumb breadcrumbs crumb crumbs pagination pager toc tabs skip"),
    ("head", "header masthead topbar top logo branding brand hero"),
    ("foot", "footer foot bottom copyright colophon legal imprint"),
    ("side", "sidebar side aside rail related widget widgets complementary recommended popular trending more tags tag cloud sitemap"),
    ("ad", "ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion promoted dfp adsense adslot affiliate teaser commercial"),
    ("notice", "cookie cookies consent gdpr notice notices alert alerts popup modal overlay disclaimer warning message toast privacy banner announcement paywall"),
    ("form", "form search login signup subscribe subscription newsletter register contact input comment-form"),
    ("talk", "comment comments commentlist discussion disqus reply replies respond feedback review reviews thread reactions"),
    ("share", "share sharing social follow facebook twitter print email author byline meta date rating"),
    ("main", "article content main post entry body story text page blog news primary single hentry"),
]
HINT_OF = {w: 1 << k for k, (_, words) in reversed(list(enumerate(HINTS))) for w in words.split()}
TAGS = "nav header footer aside form article main section div p li ul ol h1 h2 h3 h4 h5 h6 table tr td th blockquote pre figure figcaption body html #page dl dt dd address details".split()
TAG_OF = {t: k for k, t in enumerate(TAGS)}
TITLES, CONTROLS = {"h1"}, {"form", "button", "textarea", "select", "fieldset"}


def features(page: Page) -> np.ndarray:
    """A row for each element: tag, hints of its own and from above, depth, siblings, and its subtree's densities."""
    n = len(page.tags)
    own, linked, sentences, words, runs = (np.zeros(n) for _ in range(5))
    start = np.full(n, -1.0)
    seen = 0
    for k, text, links in page.runs:
        if start[k] < 0:
            start[k] = seen
        seen += len(text)
        own[k] += len(text)
        linked[k] += links
        sentences[k] += text.count(".") + text.count("!") + text.count("?") + text.count("。")
        words[k] += text.count(" ") + 1
        runs[k] += 1
    parents = page.parents
    is_a = lambda tags: np.fromiter((t in tags for t in page.tags), float, n)
    sub = np.stack([own, linked, sentences, words, runs, np.ones(n), is_a(TITLES), is_a({"p"}), is_a(CONTROLS)])
    hints = [0] * n
    above = [0] * n
    depth = [0] * n
    children = [0] * n
    order = [0] * n
    path = [0] * n
    for k in range(n):
        bits = 0
        for w in page.words[k]:
            bits |= HINT_OF.get(w, 0)
        hints[k] = bits
        p = parents[k]
        if p >= 0:
            above[k] = above[p] | hints[p]
            path[k] = path[p] | 1 << min(TAG_OF.get(page.tags[p], 62), 62)
            depth[k] = depth[p] + 1
            order[k] = children[p]
            children[p] += 1
    columns = sub.T.tolist()
    for k in range(n - 1, 0, -1):
        p, c = columns[parents[k]], columns[k]
        for i in range(len(p)):
            p[i] += c[i]
        if start[k] >= 0 and (start[parents[k]] < 0 or start[parents[k]] > start[k]):
            start[parents[k]] = start[k]
    whole = np.asarray(columns)
    up = np.maximum(np.asarray(parents), 0)
    text, link, dots, word, run, count, titles, paragraphs, controls = whole.T
    over_up = up[up]
    hint, over = np.asarray(hints), np.asarray(above)
    chain = np.asarray(path, np.uint64)
    tag = np.asarray([TAG_OF.get(t, len(TAGS)) for t in page.tags])
    some = np.maximum(text, 1)
    siblings = np.asarray(children)[up]
    out = [
        *(tag == k for k in range(len(TAGS))),
        *((hint >> k) & 1 for k in range(len(HINTS))),
        *((over >> k) & 1 for k in range(len(HINTS))),
        *((chain >> np.uint64(TAG_OF[t])) & np.uint64(1) for t in ("nav", "header", "footer", "aside", "form", "article", "main", "li")),
        np.asarray(depth),
        siblings,
        np.asarray(order) / np.maximum(siblings, 1),
        np.log1p(text),
        link / some,
        dots / some * 100,
        np.log1p(text / count),
        np.log1p(word / np.maximum(run, 1)),
        text / max(1.0, text[0]),
        text / np.maximum(text[up], 1),
        np.where(start < 0, 1.0, start / max(1.0, text[0])),
        np.log1p(count),
        np.log1p(own),
        *(x for at in (up, over_up) for x in (link[at] / some[at], dots[at] / some[at] * 100, np.log1p(word[at] / np.maximum(run[at], 1)), np.log1p(text[at]), controls[at] / run.clip(1)[at], titles[at] > 0)),
        paragraphs / count,
        controls / np.maximum(run, 1),
        titles > 0,
    ]
    return np.stack([np.asarray(x, np.float32) for x in out], axis=1)


def decoded(page: Page, odds: np.ndarray) -> list[bool]:
    """Which elements are kept: the choice closed towards the page with the largest sum of log-odds."""
    best = odds.tolist()
    for k in range(len(best) - 1, 0, -1):
        if best[k] > 0:
            best[page.parents[k]] += best[k]
    kept = [True] * len(best)
    for k in range(1, len(best)):
        kept[k] = kept[page.parents[k]] and best[k] > 0
    return kept


def main_text(page: Page, odds: np.ndarray) -> str:
    kept = decoded(page, odds)
    return "\n".join(text for k, text, _ in page.runs if kept[k])


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, seed: int = 7) -> Trees:
    rows, labels = [], []
    for source, mains in made_pages(pages, seed):
        page = Page(source)
        # an element is wanted if a marked run lies in it; others of the page are not
        wanted = [False] * len(page.tags)
        some = [False] * len(page.tags)
        for k, text, _ in page.runs:
            good = text in mains
            while k >= 0 and not (some[k] and wanted[k] >= good):
                some[k], wanted[k] = True, wanted[k] or good
                k = page.parents[k]
        use = np.asarray(some)
        rows.append(features(page)[use])
        labels.append(np.asarray(wanted)[use])
    return Trees.fit(np.concatenate(rows), np.concatenate(labels))


def extracted(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    Null and empty pages, and those without main text, have the empty text. Repeated rows have a result each.
    Markup that is cut off or unclosed is read as browsers read it. Other columns are not read.
    """
    trees = trained() if trees is None else trees

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                b = batch.slice(at, 256)
                parsed = [Page(x or "") for x in b.column("html").to_pylist()]
                rows = [features(p) for p in parsed]
                odds = np.split(trees.log_odds(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
                texts = [main_text(p, o) for p, o in zip(parsed, odds, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
