"""Ranked search, whitening and text extraction."""

import html as markup
import math
import random
import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from helpers import documents, frame, prose

from townsquare.llm import extraction, lexical, whitening

TERM = re.compile(lexical.TERM)


# --- ranked search ----------------------------------------------------------------


def terms_of(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def ranking(docs, items, top=10):
    """All scores by the formulas, on dictionaries."""
    counted = [(doc, Counter(terms_of(text))) for doc, text in docs]
    counted = [(doc, c) for doc, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms_of(text))
    out = set()
    for item, terms in wanted.items():
        scores = []
        for doc, c in counted:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms if c[t]
            )
            if score > 0:
                scores.append((-score, math.inf if doc is None else doc))
        for rank, (score, doc) in enumerate(sorted(scores)[:top], 1):
            out.add((item, rank, None if doc == math.inf else doc, -score))
    return out


def ranked(spark, docs, items, **options):
    d = frame(spark, docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    rows = [tuple(r) for r in lexical.rank_documents(d, i, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_ranking_equals_all_scores(spark):
    rng = random.Random(5)
    docs = [(r[0], r[1]) for r in documents(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(2000 + i, docs[8][1] + " river" * (i % 3)) for i in range(60)]
    items = [(i, prose(rng, rng.choice(["en", "de"]), rng.randrange(1, 30))) for i in range(30)]
    items += [(30, docs[7][1]), (31, "THE River'river"), (32, "nowhere_to be-found1"), (33, None), (34, ""), (None, "Hafen"), (2, "extra words")]
    assert ranked(spark, docs, items) == ranking(docs, items)


def test_ranking_with_small_tries(spark, monkeypatch):
    docs = [(i, prose(random.Random(i), "en", 40)) for i in range(200)]
    items = [(i, prose(random.Random(900 + i), "en", 8)) for i in range(12)]
    monkeypatch.setattr(lexical, "LEAF", 2)
    got = ranked(spark, docs, items, top=3)
    assert got == ranking(docs, items, top=3)


@pytest.mark.parametrize("seed", range(4))
def test_trie_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    n, width, top = 600, 40, 5
    chance = 1 / (1 + np.arange(width)[::-1])
    counts = (rng.random((n, width)) < chance) * rng.integers(1, 4, (n, width))
    counts[50:200] = counts[50]  # one very common vector
    counts = counts[counts.sum(axis=1) > 0]
    ids = rng.permutation(len(counts)) + 10
    m = rng.integers(10, 14, len(counts)) * 10
    m[40:180] = m[50]
    doc, term = np.nonzero(counts)
    trie = lexical.Trie(ids, m, (counts > 0).sum(axis=1), term, counts[doc, term], top)
    for _ in range(40):
        q = rng.choice(width, rng.integers(1, 8), replace=False)
        w = rng.integers(0, 5000, len(q))
        scores = (w * lexical.gain(counts[:, q], m[:, None])).sum(axis=1)
        expected = sorted((-int(s), int(i)) for s, i in zip(scores, ids) if s > 0)[:top]
        best = []
        trie.search(np.sort(q), w[np.argsort(q)], best, top)
        assert best == expected
    # The bound of a node holds for all that is below it.
    bounds = trie.bounds(0, trie.width, np.sort(q), w[np.argsort(q)])
    for node in range(trie.inner):
        low = trie.first[node]
        assert bounds[node] >= bounds[low : low + trie.count[node]].max()


def test_search_leaves_most_branches_out():
    rng = np.random.default_rng(3)
    n, width = 4000, 400
    chance = 1 / (1 + np.arange(width)[::-1])
    counts = (rng.random((n, width)) < np.maximum(chance, 0.01)).astype(int)
    doc, term = np.nonzero(counts)
    trie = lexical.Trie(np.arange(n), np.full(n, 100), counts.sum(axis=1), term, counts[doc, term], 10)
    seen, bounds = [], lexical.Trie.bounds

    class Counting(lexical.Trie):
        def bounds(self, low, high, terms, weights):
            if low >= self.inner:
                seen.append(high - low)
            return bounds(self, low, high, terms, weights)

    trie.__class__ = Counting
    best = []
    q = np.array([0, 1, 2, 398, 399])
    trie.search(q, np.array([5000, 5000, 5000, 10, 10]), best, 10)
    assert len(best) == 10 and sum(seen) < n / 4


def test_search_of_nothing(spark):
    assert ranked(spark, [], [(1, "a b")]) == set()
    assert ranked(spark, [(1, "a b")], []) == set()
    assert ranked(spark, [(1, None), (2, " ,.")], [(1, "a")]) == set()


def test_search_in_blocks_and_with_other_columns(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PAIRS", 5)
    from pyspark.sql import functions as F

    docs, items = [(r[0], r[1]) for r in documents(30)], [(i, f"river harbor n{i} Stones s") for i in range(9)]
    d = frame(spark, docs, "doc_id bigint, text string").withColumns({c: F.lit("mine") for c in ("n", "terms", "tfs", "item", "rank", "score", "bucket", "item_id")})
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("term", F.lit("mine")).withColumn("doc_id", F.lit(1))
    assert {tuple(r) for r in lexical.rank_documents(d, i).collect()} == ranking(docs, items)


# --- whitening --------------------------------------------------------------------


def whitened(spark, vectors, components=8, schema="vec_id bigint, embedding array<float>"):
    return whitening.whitening_digest(spark.createDataFrame(vectors, schema).repartition(3), components=components).collect()


def cloud(n=300, d=12, seed=2):
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
    return (rng.normal(size=(n, d)) * np.geomspace(3, 0.05, d)) @ turn + rng.normal(size=d)


def test_whitening_equals_eigenvectors(spark):
    data = cloud().astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    odd = [(900, None), (901, []), (902, [float("nan")] * 12), (903, [None] + [1.0] * 11), (904, [float("inf")] * 12), (905, [1.0] * 5)]
    got = whitened(spark, rows + odd)
    x = np.floor(1024 * data.astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    values, vectors = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    expected = (x - sums / n) @ vectors[:, :8] / np.sqrt(values[:8])
    assert len(got) == 8 * n and {r["n"] for r in got} == {n}
    for r in got:
        c = r["component"] - 1
        assert abs(abs(r["whitened"]) - abs(expected[r["vec_id"], c])) < 1e-8
        assert abs(r["explained"] - values[c] / values.sum()) < 1e-10 and r["identity_error"] < 1e-9
        assert r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[r["vec_id"]], sums)) == int(r["deviation_digits"])
    signs = np.array([[r["whitened"] * expected[r["vec_id"], r["component"] - 1] > 0] for r in got if r["component"] == 3])
    assert signs.all() or not signs.any()


def test_factor_and_rotation():
    rng = np.random.default_rng(0)
    half = rng.normal(size=(20, 7)) * np.geomspace(1e3, 1e-2, 7)
    matrix = half @ half.T
    factor = whitening.pivoted_cholesky(matrix)
    assert factor.shape == (20, 7) and np.allclose(factor @ factor.T, matrix, rtol=0, atol=1e-9 * matrix.max())
    values, unit = whitening.one_sided_jacobi(factor)
    assert np.allclose(unit.T @ unit, np.eye(7), atol=1e-13) and np.allclose(matrix @ unit, unit * values, atol=1e-8)
    assert (np.diff(values) <= 0).all() and np.allclose(values, np.linalg.svd(half)[1] ** 2, rtol=1e-6)


def test_small_eigenvalues_are_whitened_too(spark):
    data = cloud(400, 6) * np.array([1e3, 1e2, 1, 1, 0.1, 0.02])
    got = whitened(spark, [(i, v.tolist()) for i, v in enumerate(data)], schema="vec_id bigint, embedding array<double>")
    assert {r["component"] for r in got} == set(range(1, 7)) and got[0]["identity_error"] < 1e-6


def test_whitening_of_few_and_equal_vectors(spark):
    assert whitened(spark, []) == [] and whitened(spark, [(1, None)]) == []
    assert whitened(spark, [(1, [1.0, 2.0])]) == [] and whitened(spark, [(i, [1.0, 2.0]) for i in range(9)]) == []
    got = whitened(spark, [(None, [0.0, 1.0]), (None, [0.0, 3.0]), (7, [0.0, 3.0])])
    assert sorted((r["vec_id"] is None, r["component"]) for r in got) == [(False, 1), (True, 1), (True, 1)]


def test_large_entries_stay_exact(spark):
    data = [[3e14, 1.0], [-2e14, 5.0], [1e14, 1.5], [4e15, 2.0]]
    got = whitened(spark, list(enumerate(data)), schema="vec_id bigint, embedding array<double>")
    x = [[math.floor(1024 * e) + 100_000 for e in v] for v in data]
    sums = [sum(c) for c in zip(*x)]
    for r in got:
        exact = sum((4 * a - s) ** 2 for a, s in zip(x[r["vec_id"]], sums))
        assert r["deviation"] is None and int(r["deviation_digits"]) == exact


def test_whiten_keeps_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, [float(i), float(i * i)]) for i in range(6)], "vec_id bigint, embedding array<double>")
    df = df.withColumns({c: F.lit("mine") for c in ("row", "found", "v", "i", "j", "whitened")})
    got = whitening.whiten(df).collect()
    assert {r["found"] + r["row"] + r["v"] for r in got} == {"mine" * 3} and len(got[0]["whitened"]) == 2


# --- text of pages ----------------------------------------------------------------

LONG = "This is a long sentence of an article, which says a good deal more than any menu or advert ever would. " * 2


def test_sample_shape():
    page = (
        '<!DOCTYPE html><html><head><title>No</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>'
        '<nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad --><div class="ad">Buy.</div><article><h1>Short &amp; sweet &am</h1>'
        "<p><b>Eat.<br>Now<br></article><footer>&copy; us, and a very long line about nothing that goes on and on for ever</footer>"
    )
    assert extraction.main_text(page) == "Short & sweet &am Eat. Now"


def test_furniture_goes():
    page = f"""<body><header><h1>The Site</h1></header><div id="top-menu">Home, News, Sport</div>
    <div class="cookie-notice">{LONG}</div><div class="layout has-sidebar"><div class="sidebar"><p>{LONG}</p></div>
    <article class="post"><header><h1>Title</h1></header><p>{LONG}</p><div class="adSlot">{LONG}</div><p>So it was.</p>
    <p>See <a href="x">the whole story, told by a link of some length</a></p><form><p>Your name</p><textarea>{LONG}</textarea></form>
    <aside>{LONG}</aside><p>An<i>d</i> the end<span hidden>ing</span>.</p><span class="share">Share this</span></article>
    <section id="comments"><article class="comment"><p>{LONG * 9}</p></article></section></div>
    <div role="complementary">{LONG}</div><footer>{LONG}</footer></body>"""
    text = " ".join(LONG.split())
    assert extraction.main_text(page) == f"Title {text} So it was. See the whole story, told by a link of some length And the end."


def test_pages_without_an_article():
    page = f"""<div><a href="/">Home</a> <a href="/x">News</a></div><div class="x1"><h2>Head</h2><p>{LONG}</p><p>Yes.</p>
    <div class="ads">Buy</div><p>{LONG}</p></div><div><a href="/1">One more link</a></div><div>Made by us</div>"""
    text = " ".join(LONG.split())
    assert extraction.main_text(page) == f"Head {text} Yes. {text}"
    assert extraction.main_text("Just <b>a</b> text") == "Just a text"
    assert extraction.main_text(f"<main><p>Eat.</p></main><div>{LONG}</div>") == "Eat."


def test_distribution_and_humps():
    lengths = [0, 0, 5, 0, 0, 0, 9, 0, 0, 8, 0, 0, 0]
    assert extraction.distribution(lengths) == [5, 5, 5, 0, 9, 9, 9, 8, 8, 8, 0, 0, 0]
    assert extraction.humps(lengths) == [(2, 3), (6, 10)]


@pytest.mark.parametrize("page", ["", "<", "<p", "<!--", "<script>", "a<!-- b", "</p>", "<a <b", "<p title='x>y", "<li><li></ul></ul>", "&#0;&#xD800;&zzz;"])
def test_broken_pages(page):
    assert isinstance(extraction.main_text(page), str)


def test_long_and_hostile_pages():
    many = "".join(f"<p>Paragraph {i} says nothing new.</p>" for i in range(30_000))
    assert len(extraction.main_text(f"<article>{many}</article>")) > 800_000
    for part in ("<", "<a ", "<!-", "<p a='", "<div>", "&", "</b>", "=", "<script "):
        extraction.main_text(part * 30_000)


class Reference(HTMLParser):
    """What the article element holds, by the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        if tag not in ("b", "i"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        if tag not in ("b", "i"):
            self.parts.append(" ")

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_articles_equal_a_parsers(spark):
    rng, rows = random.Random(3), []
    for i in range(60):
        blocks = [markup.escape(prose(rng, "de", rng.randrange(1, 50)) + " <&> é") for _ in range(rng.randrange(1, 9))]
        body = "".join(rng.choice(["<p>{}</p>", "<p title='a>b'>{}", "<h2>{}</h2>", "<div><p><b>{}<br></div>", "<p>x<i>y</i>{}</p>"]).format(b) for b in blocks)
        rows.append((i, f"u{i}", f"<nav>Menu</nav><div class=ad>{prose(rng)}</div><article>{body}</article><div class='footer'>{prose(rng)}</div>"))
    rows += [(60, None, None), (60, None, ""), (None, "u", "<nav>only</nav>")]
    got = {(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in extraction.extraction_digest(frame(spark, rows, "page_id bigint, url string, html string")).collect()}
    expected = set()
    for page_id, url, page in rows:
        parser = Reference()
        parser.feed(page or "")
        parser.close()
        text = " ".join("".join(parser.parts).split())
        expected.add((page_id, url, text, len(text)))
    assert got == expected


def test_extract_keeps_columns(spark):
    df = frame(spark, [(1, "u", "<p>One</p>")], "page_id bigint, found string, html string")
    assert [tuple(r) for r in extraction.extract(df, result="found").select("page_id", "found").collect()] == [(1, "One")]
    assert extraction.extract(df.limit(0)).collect() == []
