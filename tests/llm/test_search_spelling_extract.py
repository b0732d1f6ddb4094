"""Spelling forms, ranked search and page extraction against plain versions, and on nulls, ties, repeated rows, long texts and empty tables."""

from __future__ import annotations

import html
import math
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tidalframe.llm import extract, layouts, search, spelling
from tidalframe.llm.dom import Forest

# ---------------------------------------------------------------- spelling


def distance_one(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_forms(rows, min_chars, min_count, every, ratio):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % every else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= min_chars and k >= min_count}
    form, out = {}, {}
    for w in n:
        near = [x for x in n if distance_one(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = [w, form[w], w, n[w], len(near), n[form[w]] if form[w] else None]
    for w in n:
        while form[out[w][2]]:
            out[w][2] = form[out[w][2]]
    return {tuple(v) for v in out.values()}


def spelling_rows():
    rng = random.Random(3)
    stems = ["kitchen", "Kitchens", "kitchén", "sitting", "aaaaaaa", "aaaaaaaa", "aaaaabaa", "abababab", "babababa", "Éclairs", "éclairs", "abcdefgh", "abcdefg", "bcdefgh", "short"]
    rows = []
    for k in range(60):
        words = [rng.choice(stems[: 1 + k % len(stems)]) for _ in range(40)]
        if k % 4 == 0:
            w = list(rng.choice(stems))
            w[rng.randrange(len(w))] = rng.choice("abxé")
            words += ["".join(w)] * 2
        rows.append((k, " ".join(words) + "×÷_1" * (k % 2)))
    return rows + [(None, "kitchen kitchen"), (61, None), (62, ""), (63, "12 ."), (5, rows[5][1]), (64, "z" * 3000 + " " + "z" * 3000 + " " + "z" * 2999 + "y " + "z" * 2999 + "y")]


def test_spelling_as_all_pairs(spark):
    rows = spelling_rows()
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, word string, n int, root int").repartition(3)
    for every, ratio in ((31, 10), (2, 2)):
        counts = spelling.count_words(docs, min_chars=7, min_count=2, reading=spelling.drop_one_in(every))
        got = [tuple(r) for r in spelling.spelling_forms(counts, ratio=ratio).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_forms(rows, 7, 2, every, ratio)


def test_near_pairs_of_every_short_word(spark):
    words = ["".join(w) for k in (1, 2, 3, 4) for w in product("abé", repeat=k)]
    df = spark.createDataFrame(list(enumerate(words)), "id long, word string").repartition(4)
    got = [tuple(sorted((r.a, r.b))) for r in spelling.near_pairs(df).collect()]
    want = {(i, j) for j in range(len(words)) for i in range(j) if distance_one(words[i], words[j])}
    assert len(got) == len(set(got)) and set(got) == want


def test_roots_of_a_long_chain(spark):
    chain = spark.createDataFrame([("abcdefg" + "x" * k, 3**k) for k in range(9)], "word string, n long")
    got = {r.word: (r.form, r.root) for r in spelling.spelling_forms(chain, ratio=2).collect()}
    assert all(root == "abcdefg" + "x" * 8 for _, root in got.values()) and got["abcdefg"][0] == "abcdefgx"


def test_spelling_of_nothing(spark, empty):
    assert spelling.spelling_forms(spelling.count_words(empty)).count() == 0


# ---------------------------------------------------------------- search


def plain_search(docs, queries, k):
    terms = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs = [(i, Counter(w), len(w)) for i, t in docs if (w := terms(t))]
    n, total = len(docs), sum(d[2] for d in docs)
    df = Counter(w for d in docs for w in d[1])
    out = []
    for item, t in dict.fromkeys(queries):
        scored = []
        for i, tf, size in docs:
            m = 100 - 25 + (25 * size * n) // total
            s = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 12 * m)) for w, c in Counter(terms(t)).items() if w in tf)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize(("shard_docs", "block_bytes", "k"), [(8192, 1 << 20, 20), (3, 200, 4), (1, 1, 1)])
def test_search_as_scoring_all(spark, docs, rows, shard_docs, block_bytes, k):
    asked = [(1, rows[7][1][:300]), (1, rows[7][1][:300]), (2, "KAta lozo lozo nothing"), (3, None), (4, ""), (5, "..."), (6, "x" * 900), (7, "你好 éß word"), (8, rows[30][1]), (8, "kata")]
    queries = spark.createDataFrame([(i, t, 1, "s") for i, t in asked], "item_id long, text string, rank int, score string")
    found = search.ranked_search(docs, queries, k=k, shard_docs=shard_docs, block_bytes=block_bytes)
    assert found.columns == ["item", "rank", "id", "score"]
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == plain_search(rows, [q for q in asked if q[1] is not None], k)


def test_max_score_drops_nothing_that_qualifies():
    rng = np.random.default_rng(2)
    for least in (1, 5, 40, 90, 1000):
        lists, whole = [], np.zeros(300, np.int64)
        for _ in range(12):
            rows = np.flatnonzero(rng.random(300) < rng.choice([0.02, 0.3, 0.9]))
            adds = rng.integers(1, rng.choice([3, 20, 40]), len(rows))
            whole[rows] += adds
            if len(rows):
                lists.append((int(adds.max()), rows, adds))
        scores = np.zeros(300, np.int64)
        found = search.max_score(lists, least, scores)
        assert found.tolist() == np.flatnonzero(whole >= least).tolist() and (scores[found] == whole[found]).all()


def test_search_restores_the_session_and_takes_empty_tables(spark, docs, empty):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    queries = spark.createDataFrame([(1, "kata")], "item_id long, text string")
    assert search.ranked_search(empty, queries).count() == 0
    assert search.ranked_search(docs, queries.where("item_id > 1")).count() == 0
    assert spark.conf.get(key) == before


# ---------------------------------------------------------------- extraction


def leaves(page):
    f = Forest()
    f.read(page)
    return [f.text[k] for k in sorted(f.text)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain  text", ["plain text"]),
        ("<p>a&amp;b &lt;c&gt; &copy; &#x41;&nbsp;d", ["a&b <c> © A d"]),
        ("<p>one<p>two</p></p>three", ["one", "two", "three"]),
        ("<P>on<b>e</B> x<br>y</P>", ["one x y"]),
        ("<script>var a='</p><p>no</p>';</script><p>yes<style>p{}</STYLE > more", ["yes more"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ["1", "2", "3"]),
        ("a<!-- <p>no</p> -->b<!-- open <p>no", ["ab"]),
        ('<div title="a > b">x</div><div title="c>y</div>', ["x", "y"]),
        ("<select><option>no</select><button>no <b>no</button>yes", ["yes"]),
        ("<head><title>no</title><p>no<body><p>yes", ["yes"]),
        ("x < y and <3 and a<b", ["x < y and <3 and a<b"]),
        ("<textarea>no", []),
        ("</div></p>text</section>", ["text"]),
    ],
)
def test_leaves(page, want):
    assert leaves(page) == want


def test_long_and_deep_pages_take_linear_time():
    for page in ("<div>" * 30_000 + "x", "<" * 300_000, "<a " * 100_000, "<!--" * 100_000, '<a "' * 100_000, "<p>word" * 50_000, "</p>" * 100_000, "<li><div>" * 20_000):
        f = Forest()
        f.read(page)
        assert f.pages == [len(f.parent)]


def brute_decode(f, log_p):
    n = len(f.parent)
    real = [any(f.leaf[k] for k in range(a, f.end[a])) for a in range(n)]
    best, which = -math.inf, None
    for s in product((0, 1, 2), repeat=n - 1):
        s = (2, *s)
        if any(f.leaf[k] and s[k] == 2 for k in range(n)) or any(s[f.parent[k]] != 2 and s[k] != s[f.parent[k]] for k in range(1, n)):
            continue
        total = sum(log_p[k][s[k]] for k in range(1, n) if real[k])
        if total > best + 1e-12:
            best, which = total, s
    return which


def test_decoding_as_trying_all():
    rng = np.random.default_rng(4)
    for page in ("<div><p>a<p>b</div><p>c", "<div>x<div>y<p>z</div></div>", "<ul><li>a<li>b</ul>t", "a"):
        f = Forest()
        f.read(page)
        for _ in range(20):
            log_p = np.log(rng.dirichlet([1, 1, 1], len(f.parent)))
            got, want = extract.decode(f, log_p.copy()), brute_decode(f, log_p)
            texts = [k for k in range(len(f.parent)) if f.leaf[k]]
            assert [got[k] for k in texts] == [want[k] for k in texts]
            assert all(got[f.parent[k]] == 2 or got[k] == got[f.parent[k]] for k in range(1, len(got)))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    words = "der die and of the que los para house river went green. under Over, small once".split()
    return extract.fit([" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(150)], n_layouts=800)


def test_layouts_that_were_not_seen(model):
    rng = random.Random(9)
    pieces = [" ".join(rng.choice("ein zwei tres cuatro five six seven, acht. nine ten".split()) for _ in range(rng.randint(1, 50))) for _ in range(80)]
    right = wrong = missed = 0
    for page in layouts.pages(pieces, 150, seed=77):
        f, label = extract._labelled([page])
        state = extract.decode(f, model.trees.log_proba(extract.features(f, model.odds)))
        for k, text in f.text.items():
            right += len(text) * (state[k] == label[k] == extract.ONLY)
            wrong += len(text) * (state[k] == extract.ONLY != label[k])
            missed += len(text) * (label[k] == extract.ONLY != state[k])
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.95


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>x("</p>")</script></head><body>
<div id="cookie-notice"><p>We use cookies on this site, and you agree.</p><button>OK</button></div>
<header class="site-header"><h2>My site</h2><nav><ul><li><a href="/">Home</a></li><li><a href="/b">About</a></li></ul></nav></header>
<main><article class="post"><h1>A title &amp; more</h1><p>This is the <b>first</b> paragraph of the article. It has words, and sentences.</p>
<div class="ad"><p>Buy our great thing now!</p></div><p>Second&nbsp;one<br>is long, and it goes on for some time.</p></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>I think that this article is great, thanks for writing it up.</p></div></section></main>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="x">Some other story</a></li></ul></aside>
<form class="newsletter"><p>Get our letter by mail every day.</p><input name=q></form><footer>&copy; 2020 My site</footer></body></html>"""
MAIN = "A title & more\nThis is the first paragraph of the article. It has words, and sentences.\nSecond one is long, and it goes on for some time."


def test_parts_of_a_page(model):
    plain = PAGE.replace("<main>", '<div class="content">').replace("</main>", "</div>").replace("article", "div").replace("<aside", "<div").replace("</aside", "</div")
    got = model.texts([PAGE, plain, "", "<p></p>"])
    assert got[0] == MAIN and got[1] == MAIN.replace("article", "div") and got[2:] == ["", ""]


def test_extract_on_tables(spark, model):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (1, "u", PAGE), (None, "n", PAGE), (4, "v", PAGE.replace("Second", "word " * 100_000)), (5, "x", "\x00<p>")]
    schema = "page_id long, url string, html string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS id", "'t' AS main_text", "2 AS n_chars").repartition(3)
    got = extract.extract(df, model, keep=("url",))
    assert got.columns == ["id", "url", "main_text", "n_chars"]
    seen = Counter((r.id, r.url, r.main_text if len(r.main_text) < 1000 else "long") for r in got.collect())
    assert all(r.n_chars == len(r.main_text) for r in got.collect())
    assert seen[(1, "u", MAIN)] == 2 and seen[(2, None, "")] == seen[(3, "u", "")] == seen[(None, "n", MAIN)] == seen[(4, "v", "long")] == 1 and sum(seen.values()) == 7
    none = spark.createDataFrame([], schema)
    assert extract.extract(none, extract.train(none, n_layouts=60)).count() == 0


def test_pages_of_the_tables(spark):
    from tidalframe.llm.queries import QUERIES

    def plain(page):
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:h1|p)>", re.search("<article>(.*?)</article>", page, re.S)[1]))
        return "\n".join(b for b in blocks if b)

    sf = "/root/testdata/sf0.001"
    want = {r.page_id: (r.url, plain(r.html)) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op13_extract"](spark, sf)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert {r.page_id: (r.url, r.text) for r in got.collect()} == want
