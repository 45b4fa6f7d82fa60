"""Fill-in-the-middle, clustering and main texts against plain versions."""

from __future__ import annotations

import collections
import hashlib
import html
import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from test_rows import CLASHES, corpus

from threadlens.llm import extraction, fim, kmeans
from threadlens.llm.dom import Page
from threadlens.llm.treemodel import Forest, TreeModel

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    extra = [(900, "<P>x", None, None, 4), (901, "<S", None, None, 2), (902, "<\U0001f600é" * 9, None, None, 27), (None, "no id", None, None, 5), (900, "<P>x", None, None, 4), (903, "ab  c, d\ne\n\nf" * 40, None, None, 1)]
    df = spark.createDataFrame(corpus() + extra, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()})


def units(text: str, unit: str) -> list[str]:
    if unit == "char":
        return list(text)
    if unit == "line":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    kind = lambda c: 0 if c.isspace() else 1 if c.isalnum() else 2
    return ["".join(g) for _, g in itertools.groupby(text, kind)]


@pytest.mark.parametrize("unit", fim.UNITS)
def test_fill_in_middle(docs, unit):
    from pyspark.sql import functions as F

    got = fim.transform(docs, unit=unit).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    want = []
    for i, t, *_ in docs.select("doc_id", "text").collect():
        h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        u, t = units(t or "", unit), t or ""
        a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
        p, m, s = ("".join(u[x:y]) for x, y in ((0, a), (a, b), (b, len(u))))
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
            want.append((i, len(u), "plain", None, None, t, t))
        elif h4 % 100 < 20:
            want.append((i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t))
        else:
            want.append((i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}
    assert fim.transform(docs.limit(0)).count() == 0


def test_tags_may_meet_at_a_cut(spark):
    """Pieces that end or begin like a tag come back unchanged, whatever the cut."""
    from pyspark.sql import functions as F

    texts = spark.createDataFrame([(i, "<<P<S<M" * 2 + "M S>P>") for i in range(400)], "doc_id long, text string")
    out = fim.transform(texts).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == 400 and {r.back for r in out} == {"<<P<S<M" * 2 + "M S>P>"} and {r.form for r in out} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_a_very_long_text(spark):
    from pyspark.sql import functions as F

    text = "é\U0001f600 x" * 1_500_000
    out = fim.transform(spark.createDataFrame([(3, text)], "doc_id long, text string")).withColumn("back", fim.restored(F.col("output"), F.col("form"))).first()
    assert out.n == len(text) and out.back == text
    with pytest.raises(ValueError):
        fim.transform(spark.createDataFrame([(3, text[:9])], "doc_id long, text string"), unit="page")


def plain_k_means(rows: list[tuple], k: int, rounds: int, dims: int, scale: int = 1024) -> dict | None:
    from fractions import Fraction

    kept = [(i, tuple(math.floor(Fraction(x) * scale) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        of = [min(range(len(cents)), key=lambda c: (far(v, cents[c]), c)) for _, v in kept]
        if step < rounds:
            for c in range(len(cents)):
                mine = [v for (_, v), a in zip(kept, of, strict=True) if a == c]
                if mine:
                    cents[c] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    dist = [far(v, cents[c]) for (_, v), c in zip(kept, of, strict=True)]
    by = collections.Counter()
    for c, d in zip(of, dist, strict=True):
        by[c] += d
    cap = lambda x: min(x, (1 << 63) - 1)
    return [(i, c, cap(d), cap(by[c]), cap(sum(dist))) for (i, _), c, d in zip(kept, of, dist, strict=True)], cents


def vectors(seed: int, n: int, dims: int) -> list[tuple]:
    rnd = random.Random(seed)
    middles = [[rnd.uniform(-1, 1) for _ in range(dims)] for _ in range(5)]
    f32 = lambda x: float(np.float32(x))
    rows = [(i, [f32(m + rnd.gauss(0, 0.3)) for m in rnd.choice(middles)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(20)]  # one vector many times
    rows += [(3, rows[3][1]), (None, rows[5][1]), (None, rows[6][1])]
    rows += [(900, None), (901, []), (902, [0.0] * (dims - 1)), (903, [0.0] * (dims - 1) + [None]), (904, [math.nan] * dims), (905, [math.inf] + [0.0] * (dims - 1)), (906, [0.0] * (dims + 1))]
    rows += [(910 + i, [float(i % 2)] * dims) for i in range(6)]  # equal distances
    return rows


@pytest.mark.parametrize(("seed", "k", "dims"), [(1, 8, 64), (2, 8, 3), (3, 3, 2), (4, 20, 4), (5, 1, 2)])
def test_clusters(spark, seed, k, dims):
    from pyspark.sql import functions as F

    rows = vectors(seed, 150, dims)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).withColumns({c: F.lit(1) for c in (*kmeans.NAMES, "label")})
    found = kmeans.Clustering(df, k=k, dims=dims)
    want, cents = plain_k_means(rows, k, 10, dims)
    assert sorted(map(tuple, found.assigned().collect()), key=str) == sorted(want, key=str)
    assert [tuple(c) for c in found.centroids] == cents
    assert all(a >= b for a, b in itertools.pairwise(found.tracked)) and found.tracked[0] == min(max(1, k // 4), k - 1)


def test_clusters_of_few_and_of_huge_vectors(spark):
    rows = [(1, [3e38, -3e38]), (2, [3e38, 1.0]), (3, [0.5, -0.5]), (4, [2.0**40, 7.0]), (5, [1e-30, -1e-30])]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for k in (2, 5, 9):
        found = kmeans.Clustering(df, k=k, dims=2)
        want, cents = plain_k_means(rows, k, 10, 2)
        assert sorted(map(tuple, found.assigned().collect())) == sorted(want) and [tuple(c) for c in found.centroids] == cents
    none = kmeans.Clustering(df.limit(0), dims=2)
    assert none.centroids == [] and none.assigned().count() == 0 and none.assigned().columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia"]
    wide = spark.createDataFrame([("a", [1e300, 0.0]), ("b", [0.1, 0.7]), (None, [0.1, 0.3])], "vec_id string, embedding array<double>")
    got = kmeans.Clustering(wide, k=2, dims=2).assigned().collect()
    assert {r.vec_id for r in got} == {"b", None}


def test_bounds_spare_scans():
    """In passes after the first, vectors whose bounds hold are not measured against any centroid but, in the last, their own."""
    rnd = np.random.default_rng(1)
    middles = rnd.integers(-4000, 4000, size=(8, 16))
    v = (middles[rnd.integers(0, 8, 4000)] + rnd.integers(-50, 50, size=(4000, 16))).astype(np.int64)
    first = kmeans.Pass(middles.tolist(), None, 2, 1024, False)
    near, upper, lows, exact, _ = first.assign(v, None, None, None)
    measured = []
    plain = kmeans._squares
    kmeans._squares = lambda a, b: measured.append(len(a)) or plain(a, b)
    try:
        moved = (middles + 3).tolist()
        later = kmeans.Pass(moved, [math.sqrt(16 * 9)] * 8, 2, 1024, False)
        near, *_ = later.assign(v, near, upper, lows)
    finally:
        kmeans._squares = plain
    assert sum(measured) < 0.1 * len(v) * 8
    assert (near[:, 0] == np.argmin(((v[:, None] - np.array(moved)) ** 2).sum(-1), axis=1)).all()


def test_cluster_query(spark):
    from threadlens.llm.queries import QUERIES

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, cents = plain_k_means(rows, 8, 10, 64)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    got = QUERIES["op12_centroids"](spark, SF)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted((*r, sha[r[1]]) for r in want)


def test_marginals_by_enumeration():
    rnd = np.random.default_rng(3)
    pages = [Page("<div class=a><p>x, y.<b>z</b><p>w</div><ul><li>q"), Page(""), Page("<p>one")]
    f, model = Forest(pages), TreeModel()
    model.weights[:], model.pairs[:] = rnd.normal(size=model.weights.shape), rnd.normal(size=model.pairs.shape)
    p, both = model.marginals(f)
    own = np.bincount(f.node, weights=model.weights[f.place], minlength=f.n)
    for a, b in itertools.pairwise(f.first):
        total, on, pair = 0.0, np.zeros(b - a), np.zeros((b - a, 2, 2))
        for y in itertools.product((0, 1), repeat=int(b - a)):
            score = sum(own[a + i] * y[i] + (model.pairs[f.kind[a + i], y[f.parent[a + i] - a], y[i]] if f.parent[a + i] >= 0 else 0) for i in range(b - a))
            total += math.exp(score)
            on += math.exp(score) * np.array(y)
            for i in range(1, b - a):
                pair[i, y[f.parent[a + i] - a], y[i]] += math.exp(score)
        assert np.allclose(p[a:b], on / total) and np.allclose(both[a + 1 : b], pair[1:] / total)


@pytest.fixture(scope="module")
def model(spark):
    return extraction.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_held_out_pages(model):
    """Laid-out pages that training has not seen, as they are and without the elements that name regions."""
    for hide, least in ((frozenset(), 0.98), (extraction.REGIONS, 0.96)):
        right = leaves = 0
        for seed in range(5000, 5150):
            page = Page(extraction.labelled_page(seed))
            said = model.marginals(Forest([page], hide))[0] > 0.5
            leaf = np.array([t == "#text" for t in page.tags])
            right, leaves = right + int((said == extraction.labels(page))[leaf].sum()), leaves + int(leaf.sum())
        assert right >= least * leaves


def test_main_text_query(spark):
    """Every page of the table against its article element, cut out by patterns."""
    from threadlens.llm.queries import QUERIES

    got = QUERIES["op13_main_text"](spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = []
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        text = "\n\n".join(b for b in blocks if b)
        want.append((r.page_id, r.url, text, len(text)))
    assert sorted(map(tuple, got.collect())) == sorted(want)


WRITTEN = [
    (
        """<!doctype html><html><head><title>Site - T</title></head><body><header><a href=/>Logo</a><p>Welcome to the site</p></header>
        <nav><ul><li><a href=#>Home</a><li><a href=#>News</a></ul></nav><div class="cookie-notice"><p>We use cookies to improve your experience.</p><button>OK</button></div>
        <main><article><h1>A title &amp; more</h1><p>First   paragraph with <a href=x>a link</a>, and some&nbsp;text.</p><div class="ad">Buy now! Best prices.</div>
        <ul><li>item one</li><li>item two</li></ul><blockquote>quoted words of somebody else.</blockquote><form><label>Your mail</label><input><button>Subscribe</button></form>
        <p>Second <b>paragraph</b>.</p><aside><h3>Related</h3><ul><li><a href=#>Other story</a></li></ul></aside><p>Last&#8212;one.</p></article>
        <section class="comments"><h3>Comments</h3><div class="comment"><p>Nice article, thanks a lot for writing it.</p></div></section></main>
        <aside class="sidebar"><p>Popular posts of the week, for you.</p></aside><footer>&copy; 2024 Someone. All rights reserved.</footer></body></html>""",
        "A title & more\n\nFirst paragraph with a link, and some text.\n\nitem one\n\nitem two\n\nquoted words of somebody else.\n\nSecond paragraph.\n\nLast—one.",
    ),
    (
        """<body><div id="page"><div id="header"><h2>My Blog</h2></div><div id="menu"><a href=1>a</a> <a href=2>b</a></div><div id="content"><div class="post"><h1>Post title</h1>
        <p>Some text here, it is long enough to be content.</p><p>Another paragraph follows, with more words in it.</p></div>
        <div id="comments"><p>reader one: great!</p><p>reader two: I do not agree, since it is wrong.</p></div></div><div id="sidebar"><p>About me: I write things.</p></div>
        <div id="footer">Powered by software.</div></div>""",
        "Post title\n\nSome text here, it is long enough to be content.\n\nAnother paragraph follows, with more words in it.",
    ),
    ("<p>Only text</p>", "Only text"),
    ("plain text &lt; only", "plain text < only"),
    ("", ""),
    (None, ""),
    ("<html><body></body></html>", ""),
    ("<!-- only a comment", ""),
    ("<script>var t = '<article><p>no</p></article>'</script>", ""),
]


def test_main_text_of_written_pages(spark, model):
    from pyspark.sql import functions as F

    rows = [(i if i != 4 else None, f"u{i}", source) for i, (source, _) in enumerate(WRITTEN)] + [(0, "u0", WRITTEN[0][0])] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("text", "n_chars", "id", "h")})
    got = extraction.extract(df, model)
    want = [(i if i != 4 else None, f"u{i}", text, len(text)) for i, (_, text) in enumerate(WRITTEN)] + [(0, "u0", WRITTEN[0][1], len(WRITTEN[0][1]))] * 3
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert extraction.extract(df.limit(0), model).count() == 0


def test_model_without_pages_of_the_table(spark):
    """The laid-out pages alone train a model; null, long and unmarked pages teach nothing."""
    df = spark.createDataFrame([(1, None), (2, ""), (None, "<article>x"), (3, "<article>" + "x " * 20_000)], "page_id long, html string")
    assert extraction.main_texts([WRITTEN[0][0]], extraction.fit(df)) == [WRITTEN[0][1]]


def test_very_long_and_deep_pages(model):
    body = "".join(f"<p>Sentence {i}, of a long page.</p>" for i in range(60_000))
    (text,) = extraction.main_texts([f"<html><body><nav><a href=#>x</a></nav><article>{body}</article></body></html>"], model)
    assert text.split("\n\n") == [f"Sentence {i}, of a long page." for i in range(60_000)]
    assert len(extraction.main_texts(["<div>" * 3000 + "deep"], model)) == 1


@pytest.mark.parametrize("bad", ["<", "<!--", "<div>", '<a b="', "</b>", "<p><div>", "<li>", "<!", "< x ", "<p>", "</p></div>", "&amp"])
def test_broken_markup_takes_linear_time(bad):
    began = time.time()
    Page(bad * (200_000 // len(bad)))
    assert time.time() - began < 10


def test_blocks():
    whole = lambda source: (p := Page(source)).text_of([True] * len(p.tags))
    assert whole("<p>a<br>b\n\tc</p>d<table><tr><td>e<td>f<tr><td>g</table>") == "a b c\n\nd\n\ne\n\nf\n\ng"
    assert whole("<ul><li>a<ul><li>b</ul>c<li>d</ul>") == "a\n\nb\n\nc\n\nd"
    assert whole("<b>a<p>b</b>c</p>x &amp;&#65;&nbsp; y<script>if (a</b) '</p>'</script >z") == "a\n\nbc\n\nx &A yz"
    assert whole("a < b <3 <i title='x>y'>c</i> <!-- d --> e<style>f") == "a < b <3 c e"
    assert whole("<div>a<div>b</div>c</div></div>d<h1>e<p>f</h1>g") == "a\n\nb\n\nc\n\nd\n\ne\n\nf\n\ng"
