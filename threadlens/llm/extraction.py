"""The main text of web pages, by a tree-structured graphical model trained on labelled pages.

Labelled pages are HTML whose elements carry ``data-main="1"`` or ``"0"``, which holds for all below. Two kinds
train the model: pages laid out by ``labelled_page`` from the usual names of regions, and a bounded sample of
the table's own pages that say where their article is.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.dom import Page
from threadlens.llm.textarrays import pieces
from threadlens.llm.treemodel import Forest, TreeModel

#: Laid-out pages, pages of the table, and the longest of them, that a model is trained on.
LAID_OUT, FIT_PAGES, FIT_CHARS = 400, 60, 20_000
#: Elements that say what they are for; on some training pages they count as ``div``.
REGIONS = frozenset("article main section nav aside header footer form dialog menu search address".split())

# The usual elements and names of the regions of a page.
ROLES = {
    "menu": ("nav", "nav navbar navigation menu breadcrumb breadcrumbs toc pagination tabs links sitemap"),
    "header": ("header", "header masthead banner topbar logo branding"),
    "footer": ("footer", "footer copyright colophon legal bottom imprint"),
    "sidebar": ("aside", "sidebar aside related recommended widget popular trending rail teaser promo"),
    "notice": ("div", "cookie cookies consent notice alert gdpr privacy warning popup modal overlay disclaimer"),
    "advert": ("div", "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner"),
    "form": ("form", "form search login signup subscribe subscription newsletter contact register"),
    "share": ("div", "share sharing social follow tools buttons toolbar tags"),
    "comments": ("section", "comments comment reply replies discussion respond responses disqus commentlist"),
}
MAIN = ("article", "content main article post entry story body text")
_PLAIN = "box inner wrapper container row col block site page left right item list unit wrap group".split()


class _Layout:
    """Pages laid out at random from a seed; texts are letters, since no word of a text is a feature."""

    def __init__(self, seed: int):
        self.rnd = random.Random(seed)
        self.stops = self.rnd.random() < 0.65  # or texts without stops and commas, such as lists of words
        self.most = self.rnd.choice((2, 6, 6, 25))  # sentences of a paragraph

    def words(self, least: int, most: int) -> str:
        return " ".join("x" * self.rnd.randint(1, 9) for _ in range(self.rnd.randint(least, most)))

    def prose(self, sentences: int) -> str:
        text = " ".join(f"{self.words(2, 9)}, {self.words(1, 9)}." if self.rnd.random() < 0.6 else f"{self.words(1, 14)}." for _ in range(sentences))
        return text if self.stops else text.replace(",", "").replace(".", self.rnd.choice(("", " |", "")))

    def named(self, names: str) -> str:
        r = self.rnd
        words = [r.choice(names.split()), *([r.choice(_PLAIN)] if r.random() < 0.5 else [])]
        return f'{r.choice(("class", "class", "id"))}="{r.choice("-_ ").join(r.sample(words, len(words)))}"'

    def links(self) -> str:
        items = [f'<li><a href="#">{self.words(1, 4)}</a></li>' if self.rnd.random() < 0.8 else f"<li>{self.words(1, 3)}</li>" for _ in range(self.rnd.randint(2, 8))]
        return f"<ul>{''.join(items)}</ul>"

    def paragraphs(self, n: int) -> str:
        r, out = self.rnd, []
        for _ in range(n):
            text = self.prose(r.randint(1, self.most)) if r.random() < 0.8 else f"{self.words(1, 2)}."
            kind = r.random()
            if kind < 0.12:
                text = f"<b>{text}<br>"
            elif kind < 0.3:
                text += f' <a href="#">{self.words(1, 3)}</a> {self.prose(1)}'
            out.append(f"<p>{text}" + ("</p>" if r.random() < 0.8 else ""))
        return "".join(out)

    def region(self, role: str) -> str:
        r = self.rnd
        element, names = ROLES[role]
        tag = element if r.random() < 0.5 else r.choice(("div", "div", "section", "ul" if role == "menu" else "div"))
        named = f" {self.named(names)}" if tag in ("div", "section", "ul") or r.random() < 0.5 else ""
        if role == "comments":
            one = lambda: f'<div class="{r.choice(("comment", "reply", "item", "vcard"))}"><p>{self.words(1, 2)}</p>{self.paragraphs(r.randint(1, 2))}</div>'
            inner = f"<h3>{self.words(1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 4)))
        elif role == "form":
            inner = f"<label>{self.words(1, 3)}</label><input><button>{self.words(1, 2)}</button>" + (f"<p>{self.prose(1)}</p>" if r.random() < 0.4 else "")
        elif role in ("menu", "share") or role in ("sidebar", "header", "footer") and r.random() < 0.5:
            inner = (f"<h4>{self.words(1, 2)}</h4>" if r.random() < 0.3 else "") + self.links()
        elif r.random() < 0.5:
            inner = self.prose(r.randint(1, 4)) + (f' <a href="#">{self.words(1, 2)}</a>' if r.random() < 0.4 else "")
        else:
            inner = (f"<h3>{self.words(1, 3)}</h3>" if r.random() < 0.4 else "") + self.paragraphs(r.randint(1, 3))
        return f'<{tag}{named} data-main="0">{inner}</{tag}>'

    def regions(self, roles: tuple[str, ...], share: float) -> str:
        return "".join(self.region(role) for role in roles if self.rnd.random() < share)

    def parts(self) -> str:
        r = self.rnd
        parts = [f"<h1>{self.words(2, 9)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 5)):
            kind = r.random()
            if kind < 0.15:
                parts.append(f"<h2>{self.words(1, 5)}</h2>")
            elif kind < 0.25:
                parts.append(f"<{'ol' if r.random() < 0.3 else 'ul'}>" + "".join(f"<li>{self.prose(1)}" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.32:
                parts.append(f"<blockquote>{self.paragraphs(1)}</blockquote>")
            elif kind < 0.38:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif kind < 0.43:
                parts.append(f"<pre>{self.words(2, 9)}</pre>")
            parts.append(self.paragraphs(r.randint(1, 5)))
            if r.random() < 0.2:
                parts.append(self.region(r.choice(("advert", "sidebar", "share", "form", "notice"))))
        if r.random() < 0.3:
            parts.append(self.region("comments"))
        return "".join(parts)

    def article(self) -> str:
        r, inner = self.rnd, self.parts()
        element, names = MAIN
        tag = r.choice((element, element, "main", "div", "section"))
        named = f" {self.named(names)}" if tag in ("div", "section") or r.random() < 0.3 else ""
        if r.random() < 0.25:
            inner = f"<div {self.named('text body content inner')}>{inner}</div>"
        return f'<{tag}{named} data-main="1">{inner}</{tag}>'

    def page(self) -> str:
        kind = self.rnd.random()
        if kind < 0.08:  # a fragment: all of it is text
            return self.paragraphs(self.rnd.randint(1, 4)) if kind < 0.05 else self.prose(self.rnd.randint(1, 4))
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{}}</style><script>var t='</p>';</script></head>"
        before = self.regions(("notice", "header", "menu", "form", "advert", "sidebar"), 0.4)
        after = self.regions(("sidebar", "advert", "comments", "share", "menu", "notice", "footer"), 0.4)
        body = before + self.article() + after
        mark = ""
        if kind < 0.18:  # the body itself holds the article's parts
            mark, body = ' data-main="1"', before + self.parts() + after
        elif self.rnd.random() < 0.5:
            body = f'<div class="{self.rnd.choice(_PLAIN)}">{body}</div>'
        return f"<!DOCTYPE html><html>{head}<body{mark}>{body}</body></html>"


def labelled_page(seed: int) -> str:
    """A page with labels, laid out at random; the same seed gives the same page."""
    return _Layout(seed).page()


_BOILERPLATE = frozenset("nav aside footer form dialog menu search button".split())


def labels(page: Page, by_markup: bool = False) -> np.ndarray:
    """Each node's label: the nearest mark at it or above it, else not content; without any mark all is content.

    ``by_markup`` takes the page's elements for marks instead: article and main, and within them the regions that are not text.
    """
    marks = page.marks or {0: True}
    if by_markup:
        marks = {i: t in ("article", "main") for i, t in enumerate(page.tags) if t in ("article", "main") or t in _BOILERPLATE}
    label = np.zeros(len(page.tags), dtype=bool)
    for i, above in enumerate(page.parents):
        label[i] = marks.get(i, bool(label[above]) if above >= 0 else False)
    return label


def train(sample: list[str], laid_out: int = LAID_OUT) -> TreeModel:
    """A model from laid-out pages and a sample of pages that hold an article or main element.

    Half of the pages come once more with ``REGIONS`` hidden and a quarter without names, so that what a
    region holds and where it stands count as well as what it is called.
    """
    made = [Page(labelled_page(seed)) for seed in range(laid_out)]
    own = [Page(source) for source in sample]
    pages, marks = made + own, [labels(p) for p in made] + [labels(p, by_markup=True) for p in own]
    forests, truth = [Forest(pages)], [np.concatenate([*marks, np.zeros(0, bool)])]
    for hide, nameless, step in ((REGIONS, False, 2), (frozenset(), True, 4)):
        forests.append(Forest(pages[::step], hide, nameless))
        truth.append(np.concatenate([*marks[::step], np.zeros(0, bool)]))
    return TreeModel().fit(_joined(forests), np.concatenate(truth))


def _joined(forests: list[Forest]) -> Forest:
    """One forest of several."""
    out, base = forests[0], 0
    parent, kind, node, place, levels = [], [], [], [], []
    for f in forests:
        parent.append(np.where(f.parent < 0, -1, f.parent + base))
        kind.append(f.kind)
        node.append(f.node + base)
        place.append(f.place)
        for i, level in enumerate(f.levels):
            if i == len(levels):
                levels.append([])
            levels[i].append(level + base)
        base += f.n
    out.n, out.levels = base, [np.concatenate(x) for x in levels]
    out.parent, out.kind, out.node, out.place = map(np.concatenate, (parent, kind, node, place))
    return out


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = FIT_PAGES) -> TreeModel:
    """A model trained with up to ``sample`` of the table's pages: of those with the least hashed ids, the ones
    that hold an article or main element and ``FIT_CHARS`` characters at most, in the order of their hashes.

    Ids are read first and alone; a filter on the chosen ids then spares the row groups without any. Pages
    without id or html teach nothing; an empty table leaves the laid-out pages; other columns are ignored.
    """
    by_hash = F.xxhash64(F.col(id_col).cast("string"))
    ids = [r[0] for r in pages.where(F.col(id_col).isNotNull()).select(id_col).distinct().orderBy(by_hash, id_col).limit(2 * sample).collect()]
    chosen = pages.where(F.col(id_col).isin(ids)).select(F.col(html_col).cast("string").alias("html"), by_hash.alias("h"))
    chosen = chosen.where((F.length("html") <= FIT_CHARS) & F.lower("html").rlike(r"<(article|main)[\s>]"))
    rows = chosen.orderBy("h", "html").limit(sample).collect()  # ``sample`` pages of ``FIT_CHARS`` at most
    return train([r["html"] for r in rows])


def main_texts(sources: list[str], model: TreeModel) -> list[str]:
    pages = [Page(s) for s in sources]
    forest = Forest(pages)
    content = model.marginals(forest)[0] > 0.5
    return [p.text_of(content[a:b].tolist()) for p, a, b in zip(pages, forest.first[:-1], forest.first[1:], strict=True)]


def extract(pages: DataFrame, model: TreeModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id_col, url_col, text, n_chars (code points).

    The text holds, in page order, the blocks of the nodes whose marginal is over a half: character references
    decoded, white space (of Unicode) inside a block turned into one space, blocks two line feeds apart.

    A null or empty page, and one without content, gives the empty text. Whole pages are read, however long
    or deep, some megabytes of pages at a time; broken markup is closed as browsers close it, but for text
    that they would move out of tables. A node at exactly a half is not content. Repeated rows get equal
    answers, ids are not looked at, an empty table gives an empty result, other columns are ignored. The
    model is broadcast: some hundred kilobytes whatever the pages.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)
    sent = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, 2):
                texts = main_texts(b.column(2).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kinds = [f.dataType.simpleString() for f in sent.schema.fields[:2]]
    out = sent.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
