"""Main text of web pages: boosted trees over DOM nodes, decoded over the hierarchy.

Every block element and text leaf is a node with features of its tag, its
attribute words, its depth, its siblings, its ancestors and its subtree's text
and links. Boosted trees give each node the chance that it holds main text.
Choices are made for the whole tree at once: what lies below a dropped node is
dropped, a kept node has kept ancestors, and the most likely choice of that
kind wins.

The trees are trained on pages rendered here: random layouts around text
sampled from the given pages, so that the place of the main text is known.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship, slices, text_column
from .dom import LEAF, Page, parse

TAGS = (
    LEAF, "p", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "ul", "ol", "li",
    "h1", "h2", "h3", "table", "tr", "td", "figure", "blockquote", "pre", "button",
)
_TAG = {t: i + 1 for i, t in enumerate(TAGS)}
LANDMARKS = ("article", "main", "nav", "header", "footer", "aside", "form", "ul", "table")
#: Pages of text per task slice.
PAGES = 64


@dataclass(frozen=True)
class Fit:
    """Bounds of the training: pages that lend text, characters read of each, pages rendered; the trees."""

    lenders: int = 200
    characters: int = 20_000
    rendered: int = 500
    trees: int = 60
    depth: int = 4
    bins: int = 32
    rate: float = 0.25
    ridge: float = 1.0


# ---------------------------------------------------------------- features

def features(pages: list[Page], words: dict[str, float]) -> np.ndarray:
    """One row a node, over all ``pages`` in order."""
    rows = []
    for page in pages:
        n = len(page.tag)
        parent = np.array(page.parent)
        end = np.array(page.end)
        at = np.arange(n)
        size = np.array([len(t) for t in page.text], np.float64)
        leaf = np.array([t == LEAF for t in page.tag])
        stops = np.array([t.count(",") + t.count(".") for t in page.text], np.float64)
        gaps = np.array([t.count(" ") for t in page.text], np.float64)

        def below(x: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0.0], np.cumsum(x)))
            return total[end] - total[at]

        text, link, leaves = below(size), below(np.array(page.link, np.float64)), below(leaf.astype(np.float64))
        own = np.array([sum(words.get(w, 0.0) for w in names) for names in page.names])
        tag = np.array([_TAG.get(t, 0) for t in page.tag])
        marks = np.zeros((n, len(LANDMARKS)))
        low, high = np.minimum(own, 0), np.maximum(own, 0)
        for k, name in enumerate(LANDMARKS):
            marks[:, k] = [t == name for t in page.tag]
        up = page.parent
        siblings, order = np.ones(n), np.zeros(n)
        children = np.zeros(n)
        seen: dict[int, int] = {}
        for i in range(1, n):
            p = up[i]
            marks[i] = np.maximum(marks[i], marks[p])
            low[i], high[i] = min(low[i], low[p]), max(high[i], high[p])
            order[i] = seen.get(p, 0)
            seen[p] = seen.get(p, 0) + 1
        for p, k in seen.items():
            children[p] = k
        siblings[1:] = children[parent[1:]]
        up_text = np.where(parent >= 0, text[np.maximum(parent, 0)], text)
        best = max(text[0], 1.0)
        before = np.concatenate(([0.0], np.cumsum(size)))[at]
        rows.append(np.column_stack([
            tag, tag[np.maximum(parent, 0)], np.array(page.depth), own, low, high, marks,
            np.log1p(text), np.log1p(leaves), text / np.maximum(leaves, 1), link / np.maximum(text, 1),
            np.log1p(end - at), text / np.maximum(end - at, 1), below(stops) / np.maximum(text, 1), below(gaps) / np.maximum(text, 1),
            np.log1p(siblings), order / np.maximum(siblings, 1), text / np.maximum(up_text, 1), text / best,
            before / best, (before + text) / best, link[np.maximum(parent, 0)] / np.maximum(up_text, 1),
        ]))
    return np.concatenate(rows)


def truth(page: Page) -> np.ndarray:
    """1 for nodes that hold main text somewhere below."""
    kept = np.array([t == LEAF and k for t, k in zip(page.tag, page.kept)], np.int64)
    total = np.concatenate(([0], np.cumsum(kept)))
    return (total[np.array(page.end)] > total[:-1]).astype(np.float64)


# ---------------------------------------------------------------- boosted trees

@dataclass
class Trees:
    """Full binary trees as arrays: feature and limit of each inner node, value of each leaf."""

    start: float = 0.0
    feature: list = field(default_factory=list)
    limit: list = field(default_factory=list)
    value: list = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), np.int64)
            while True:
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
                if node[0] >= len(feature):
                    break
            out += value[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, how: Fit) -> Trees:
    """Gradient boosting of the logistic loss, level by level, on binned features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, how.bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    out = Trees(start=float(np.log(mean / (1 - mean))))
    z = np.full(len(y), out.start)
    inner = (1 << how.depth) - 1
    for _ in range(how.trees):
        p = 1 / (1 + np.exp(-z))
        slope, curve = y - p, p * (1 - p)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(how.depth):
            first, width = (1 << level) - 1, 1 << level
            place = (node - first) * how.bins
            gain, split = np.zeros(width), np.full((width, 2), -1)
            for f, column in enumerate(binned):
                g = np.bincount(place + column, slope, width * how.bins).reshape(width, -1).cumsum(1)
                h = np.bincount(place + column, curve, width * how.bins).reshape(width, -1).cumsum(1)
                rest_g, rest_h = g[:, -1:] - g, h[:, -1:] - h
                score = g**2 / (h + how.ridge) + rest_g**2 / (rest_h + how.ridge) - g[:, -1:] ** 2 / (h[:, -1:] + how.ridge)
                score = np.where((h > 1e-2) & (rest_h > 1e-2), score, 0)[:, : len(edges[f])]
                if score.shape[1]:
                    b = score.argmax(1)
                    s = score[np.arange(width), b]
                    better = s > gain + 1e-9
                    gain = np.where(better, s, gain)
                    split[better] = np.column_stack([np.full(width, f), b])[better]
            for k, (f, b) in enumerate(split):
                if f >= 0:
                    feature[first + k], limit[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        leaf = node - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, curve, inner + 1)
        value = how.rate * g / (h + how.ridge)
        z += value[leaf]
        out.feature.append(feature)
        out.limit.append(limit)
        out.value.append(value)
    return out


# ---------------------------------------------------------------- decoding

def decode(page: Page, logits: np.ndarray) -> list[str]:
    """Texts of the kept leaves, in page order, under the likeliest choice without contradictions.

    Dropping a node drops all below it; keeping a node leaves each child free.
    """
    n = len(page.tag)
    keep = (-np.logaddexp(0, -logits)).tolist()  # log of the chance
    drop = (-np.logaddexp(0, logits)).tolist()
    parent = page.parent
    for i in range(n - 1, 0, -1):
        p = parent[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    chosen = [False] * n
    out = []
    for i in range(n):
        chosen[i] = keep[i] > drop[i] and (i == 0 or chosen[parent[i]])
        if chosen[i] and page.text[i]:
            out.append(page.text[i])
    return out


# ---------------------------------------------------------------- training pages

# Words that authors put in class, id and role attributes.
_MAIN = "content article post main body entry story text prose markdown page".split()
_ASIDE = {
    "menu": "nav menu navbar navigation breadcrumb topbar links tabs".split(),
    "header": "header masthead banner branding logo top".split(),
    "footer": "footer bottom copyright legal colophon".split(),
    "side": "sidebar aside widget related rail trending recommended".split(),
    "advert": "ad ads advert advertisement sponsor sponsored promo banner".split(),
    "notice": "cookie notice consent alert gdpr banner popup modal".split(),
    "form": "form newsletter subscribe signup search login".split(),
    "comments": "comments comment replies discussion respond thread".split(),
    "share": "share social buttons follow".split(),
}


class Renderer:
    """Random pages around given prose and short texts; main blocks are marked ``data-kept``."""

    def __init__(self, prose: list[str], short: list[str], seed: int):
        self.prose, self.short, self.r = prose, short, random.Random(seed)

    def _escaped(self, text: str) -> str:
        return text.replace("&", "&amp;").replace("<", "&lt;")

    def line(self, low: int, high: int) -> str:
        words = self.r.choice(self.prose).split()
        k = self.r.randint(low, high)
        start = self.r.randrange(max(1, len(words) - k))
        return self._escaped(" ".join(words[start : start + k]) or "x")

    def paragraph(self) -> str:
        text = self.r.choice(self.prose)
        if self.r.random() < 0.4:
            text = " ".join(text.split()[: self.r.randint(1, 40)])
        text = self._escaped(text)
        return self.r.choice(("", "", "<b>")) + text + self.r.choice(("", "", "<br>", f" <a href='/x'>{self.line(1, 4)}</a>"))

    def attribute(self, words: list[str], odds: float = 0.7) -> str:
        if self.r.random() > odds:
            return ""
        name = self.r.choice(words)
        if self.r.random() < 0.4:
            name += self.r.choice("-_ ") + self.r.choice([*words, "wrap", "box", "inner", "area", "container"])
        return f' {self.r.choice(("class", "class", "id"))}="{name}"'

    def links(self, low: int, high: int) -> str:
        return "".join(
            f"<li><a href='/{i}'>{self.line(1, 3)}</a></li>" if self.r.random() < 0.9 else f"<li>{self.line(1, 3)}</li>"
            for i in range(self.r.randint(low, high)))

    def aside(self, kind: str) -> str:
        r = self.r
        a = self.attribute(_ASIDE[kind], 0.95 if kind in ("advert", "notice", "comments", "share") else 0.6)
        if kind == "menu":
            inner = f"<ul>{self.links(2, 9)}</ul>"
            return f"<nav{a}>{inner}</nav>" if r.random() < 0.7 or not a else f"<div{a}>{inner}</div>"
        if kind == "header":
            inner = r.choice((f"<h1>{self.line(1, 4)}</h1>", f"<a href='/'>{self.line(1, 3)}</a>", f"<p>{self.line(2, 8)}</p>"))
            return f"<header{a}>{inner}{self.aside('menu') if r.random() < 0.4 else ''}</header>"
        if kind == "footer":
            inner = r.choice((f"&copy; {self.line(2, 25)}", f"<p>&copy; {self.line(3, 30)}</p>", f"<ul>{self.links(2, 6)}</ul><p>{self.line(2, 12)}</p>"))
            return f"<footer{a}>{inner}</footer>" if r.random() < 0.8 or not a else f"<div{a}>{inner}</div>"
        if kind == "side":
            inner = r.choice((f"<h3>{self.line(1, 4)}</h3><ul>{self.links(2, 8)}</ul>", f"<p>{self.line(5, 40)}</p>"))
            return f"<aside{a}>{inner}</aside>" if r.random() < 0.7 or not a else f"<div{a}>{inner}</div>"
        if kind == "form":
            inner = r.choice((f"<label>{self.line(1, 4)}</label><input name=q>", f"<p>{self.line(3, 15)}</p><input><button>{self.line(1, 2)}</button>"))
            return f"<form{a}>{inner}</form>"
        if kind == "comments":
            inner = "".join(f"<{t}{self.attribute(_ASIDE[kind])}><b>{self.line(1, 2)}</b><p>{self.paragraph()}</p></{t}>"
                            for t in [r.choice(("div", "li", "article"))] for _ in range(r.randint(1, 5)))
            return f"<{(t := r.choice(('section', 'div', 'ol')))}{a or ' id=comments'}><h3>{self.line(1, 3)}</h3>{inner}</{t}>"
        if kind == "share":
            return f"<{(t := r.choice(('div', 'ul')))}{a}>{self.links(2, 5) if t == 'ul' else ''.join(f'<a href=#>{self.line(1, 2)}</a> ' for _ in range(3))}</{t}>"
        inner = self.line(1, 30)
        return f"<{(t := r.choice(('div', 'div', 'section', 'p', 'aside')))}{a or ' class=' + r.choice(_ASIDE[kind])}>{inner if r.random() < 0.6 else f'<p>{inner}</p>'}</{t}>"

    def block(self) -> str:
        kind = self.r.random()
        if kind < 0.78:
            return f"<p data-kept>{self.paragraph()}" + self.r.choice(("</p>", "</p>", ""))
        if kind < 0.84:
            return f"<h2 data-kept>{self.line(2, 9)}</h2>"
        if kind < 0.89:
            return "<ul data-kept>" + "".join(f"<li>{self.line(3, 25)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote data-kept><p>{self.paragraph()}</p></blockquote>"
        if kind < 0.95:
            return f"<pre data-kept>{self.line(3, 30)}</pre>"
        if kind < 0.97:
            return "<table data-kept>" + "".join(f"<tr><td>{self.line(1, 5)}</td><td>{self.line(1, 8)}</td></tr>" for _ in range(3)) + "</table>"
        return f"<div data-kept>{self.paragraph()}</div>"

    def page(self) -> str:
        r = self.r
        if r.random() < 0.08:  # nothing but text
            return f"<body data-kept>{self.paragraph()}" + "".join(f"<p>{self.paragraph()}" for _ in range(r.choice((0, 0, 1, 4))))
        blocks = [self.block() for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14)))]
        for _ in range(r.choice((0, 0, 1, 2))):
            blocks.insert(r.randint(0, len(blocks)), self.aside(r.choice(("advert", "share", "form", "side", "notice"))))
        title = f"<h1 data-kept>{self.line(1, 12)}</h1>" if r.random() < 0.8 else ""
        if title and r.random() < 0.2:
            title = f"<header>{title}</header>"
        inner = title + "".join(blocks)
        if r.random() < 0.25:
            inner += self.aside("comments")
        shell = r.random()
        if shell < 0.5:
            inner = f"<article{self.attribute(_MAIN, 0.3)}>{inner}</article>"
        elif shell < 0.65:
            inner = f"<main{self.attribute(_MAIN, 0.3)}>{inner}</main>"
        elif shell < 0.92:
            inner = f"<div{self.attribute(_MAIN, 0.9)}>{inner}</div>"
        for _ in range(r.choice((0, 0, 1, 2))):
            inner = f"<{(t := r.choice(('div', 'div', 'section', 'main')))}{r.choice(('', ' class=wrap', ' id=page', ' class=container'))}>{inner}</{t}>"
        around = ("notice", "header", "menu", "menu", "advert", "form", "side")
        before = [self.aside(k) for k in around if r.random() < 0.4]
        after = [self.aside(k) for k in ("comments", "side", "share", "advert", "form", "menu", "footer") if r.random() < (0.75 if k == "footer" else 0.25)]
        if r.random() < 0.3:
            r.shuffle(before)
        return "<html><head><title>x</title></head><body>" + "".join(before) + inner + "".join(after) + r.choice(("</body></html>", ""))


_FILLER = ("Plain words stand here, one after the other. They are only used where a table gives no text of its own.",)


class Model:
    def __init__(self, trees: Trees, words: dict[str, float]):
        self.trees, self.words = trees, words

    def extract(self, sources: list[str]) -> list[str]:
        pages = [parse(s) for s in sources]
        logits = self.trees.logits(features(pages, self.words)) if pages else np.empty(0)
        out, at = [], 0
        for page in pages:
            out.append("\n".join(decode(page, logits[at : at + len(page.tag)])))
            at += len(page.tag)
        return out


def train(sources: list[str], how: Fit = Fit(), seed: int = 7) -> Model:
    """Trees trained on rendered pages with the texts of ``sources``."""
    prose, short = [], []
    for source in sources:
        for text in parse(source).text:
            (prose if len(text) >= 60 else short).append(text[:2000])
    renderer = Renderer(prose or list(_FILLER), short or ["x"], seed)
    pages = [parse(renderer.page()) for _ in range(how.rendered)]
    labels = [truth(p) for p in pages]
    held, all_nodes = Counter(), Counter()
    for page, y in zip(pages, labels):
        for names, kept in zip(page.names, y):
            for w in set(names):
                all_nodes[w] += 1
                held[w] += int(kept)
    words = {w: float(np.log((held[w] + 1) / (n - held[w] + 1))) for w, n in all_nodes.items() if n >= 3}
    return Model(boost(features(pages, words), np.concatenate(labels), how), words)


def lend(pages: DataFrame, how: Fit) -> list[str]:
    """At most ``lenders`` pages whose text fills the training pages: the smallest hash in each of so many buckets."""
    html = F.col("html").cast("string")
    rows = pages.where(F.length(html) > 0).select(F.xxhash64(html, F.lit(5)).alias("hash"), F.substring(html, 1, how.characters).alias("html"))
    rows = rows.withColumn("bucket", F.pmod("hash", F.lit(how.lenders)))
    low = rows.groupBy("bucket").agg(F.min("hash").alias("hash"))
    # At most ``lenders`` rows, and copies of a page come back once.
    found = rows.join(F.broadcast(low), ["bucket", "hash"]).groupBy("hash").agg(F.min("html").alias("html")).collect()
    return [r.html for r in sorted(found)]


def extract(pages: DataFrame, how: Fit = Fit()) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) read from its column ``html``.

    Null and empty html give an empty text. Every row is read whole and on its
    own; repeated rows give equal texts. Columns of the two names are replaced.
    """
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(train(lend(pages, how), how))
    rows = pages.drop("text", "n_chars").withColumn("text", F.lit(""))
    keep = [c for c in rows.columns if c not in ("html", "text")]
    rows = rows.select(*keep, F.col("html").cast("string").alias("html"), "text")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, PAGES):
            texts = shared.value.extract(text_column(batch, "html"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keep, "html")), pa.array(texts, pa.string())], names=[*keep, "html", "text"])

    return rows.mapInArrow(extracted, rows.schema).withColumn("n_chars", F.length("text").cast("long"))


def main_texts(pages: DataFrame, how: Fit = Fit()) -> DataFrame:
    """page_id, url, text, n_chars for every row; an empty table gives no rows, and the trees then learn from filler text."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return extract(rows, how).select("page_id", "url", "text", "n_chars")
