"""Divergence, collocations and main texts against SQL, brute force and labelled pages; their odd rows."""

import glob
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwright.llm import collocations, divergence, dom_blocks, layouts, main_text, queries, word_blocks

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "alpha beta, gamma alpha beta. " * 20000
ROWS = [
    (1, "A b c. A b c! a B c", "en", "x", 7), (1, "A b c. A b c! a B c", "en", "x", 7), (2, None, "en", "x", 7), (3, "", None, None, 7), (4, " \t\n ,,", "de", "y", 7), (None, "é é é É", None, "y", 7),
    (5, LONG, "en", "z", 7), (6, "one", "", "", 7), (7, "w\u0000x w\u0000x, 12 \U0001f600 34", "und", "y", 7), (8, "a b c d a b c d", "en", "y", 7),
]
#: Extra columns named as results and helpers are.
EXTRA = ["term", "n", "p", "q", "bucket", "rank", "value", "phrase", "words", "score", "item", "part", "total"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").select("*", *(F.lit(1).alias(c) for c in EXTRA))


def _rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("name", ["op11_divergence", "op12_collocations", "op13_main_text"])
def test_query_by_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = queries.queries()[name](spark, SF)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert _rows(got) == sorted(map(repr, want)) and want


def _audit(rows, least, top):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(LOW))) for r in rows]
    df, count, langs = Counter(), Counter(), {}
    for lang, source, words in docs:
        langs.setdefault(lang, set()).add(source)
        df.update((lang, w) for w in set(words))
        count.update((lang, source, w) for w in words)
    out = []
    for lang, sources in langs.items():
        kept = [w for (of, w), n in df.items() if of == lang and n >= least]

        def shares(counts):
            total = sum(counts[w] for w in kept)
            return {w: 1 + 10**9 * (counts[w] + 5) // (total + 5 * len(kept)) for w in kept}

        of = {s: Counter({w: count[lang, s, w] for w in kept}) for s in sources}
        p, q = {s: shares(c) for s, c in of.items()}, shares(sum(of.values(), Counter()))
        for s in sources:
            pair = sorted(((-sum(abs(p[s][w] - p[o][w]) for w in kept), o.encode()) for o in sources if o != s))
            term = sorted((q[w] - p[s][w], w.encode()) for w in kept if of[s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, part, o.decode(), -v, k + 1) for part, found in (("pair", pair), ("term", term)) for k, (v, o) in enumerate(found)]
    return sorted(map(repr, out))


def test_audit_by_brute_force(spark, docs, monkeypatch):
    assert _rows(divergence.audit(docs, least_docs=1)) == _audit(ROWS, 1, 50)
    assert divergence.audit(docs.limit(0)).count() == 0
    assert {r.value for r in divergence.audit(docs, least_docs=99).collect()} == {0}
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 3))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words[: rng.choice((5, 60, 300))]) for _ in range(rng.randint(0, 90))), rng.choice(("en", "de", None)), rng.choice("stuvw"), 0) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    # Small blocks, several buckets and slots, and few terms a round.
    monkeypatch.setattr(divergence, "BUCKET", 1000)
    monkeypatch.setattr(divergence, "POSTINGS", 100)
    for top in (1, 3, 50):
        assert _rows(divergence.audit(df, least_docs=2, top=top)) == _audit(rows, 2, top)


def test_shares_beyond_64_bits(spark):
    row = spark.range(1).select(divergence._share(F.lit(10**12), F.lit(3 * 10**12), F.lit(7)).alias("p"), divergence._share(F.lit(0), F.lit(0), F.lit(0)).alias("none")).first()
    assert row.p == 1 + 10**9 * (10**12 + 5) // (3 * 10**12 + 35) and row.none is None
    a, left, right = 3 * 10**12, 5 * 10**12, 4 * 10**12
    assert spark.range(1).select(collocations._score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first().s == 10**6 * a * a // (left * right)


def _phrases(rows, longest):
    f, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return f, total


def _collocations(rows, longest, least, top, share=50):
    f, total = _phrases(rows, longest)
    c = {k: n for k, n in f.items() if n >= least and len(k[1]) > 1}
    out = {}
    for (lang, g), a in c.items():
        if any(of == lang and len(h) > len(g) and 100 * n >= share * a and any(h[i : i + len(g)] == g for i in range(len(h))) for (of, h), n in c.items()):
            continue
        cuts = [(10**6 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), left, right))
    return sorted(repr((lang, k + 1, g.decode(), -a, left, right, total[lang], -s)) for lang, found in out.items() for k, (s, a, g, left, right) in enumerate(sorted(found)[:top]))


def test_collocations_by_brute_force(spark, docs, monkeypatch):
    assert _rows(collocations.collocations(docs, least=2)) == _collocations(ROWS, 3, 2, 2000)
    assert collocations.collocations(docs.limit(0)).count() == 0
    rng = random.Random(4)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 2))) for _ in range(14)]
    rows = [(i, "".join(rng.choice(words) + rng.choice(("  ", " ", " ", "\t", ", ", ".")) for _ in range(rng.randint(0, 60))), rng.choice(("en", "de", None)), "s", 0) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    monkeypatch.setattr(collocations, "BUCKET", 500)
    monkeypatch.setattr(word_blocks, "GATHER", 7)
    monkeypatch.setattr(collocations, "RANKED", 20)
    for longest, top in ((2, 5), (3, 2000), (4, 30), (5, 2000)):
        assert _rows(collocations.collocations(df, longest=longest, least=3, top=top)) == _collocations(rows, longest, 3, top)


def test_suffix_arrays_sort_by_the_first_words():
    rng = np.random.default_rng(2)
    for longest in range(1, 8):
        ids = rng.integers(1, 4, 200)
        order, common = collocations.suffix_array(ids, longest)
        first = [tuple(np.r_[ids, np.zeros(longest, int)][i : i + longest]) for i in order]
        assert sorted(order) == list(range(200)) and first == sorted(first)
        for a, b, n in zip(first, first[1:], common[1:]):
            same = next((k for k in range(longest) if a[k : k + 1] != b[k : k + 1]), longest)
            assert n == min(same, longest)


def test_packed_keys_round_trip():
    keys = pa.array(["a", "", "é b", "x" * 40, "c"], pa.large_string())
    start = np.array([0, 2, 4])
    back, each = word_blocks.split(word_blocks.joined(keys, start))
    assert back.to_pylist() == keys.to_pylist() and list(each) == [2, 2, 1]


def test_leaf_blocks():
    page = dom_blocks.read("<title>T &amp; t</title><p class='lead fooBar'>a &lt;b&gt;<i>c</i>d<p>e<br>f<ul><li>g<li><a href='x>y'>h</a></ul><table><tr><td>1<td>2<tr><td>3</table>4 < 5<script>'<p>'</script><!-- <p> --><p hid")
    assert page.title == "T & t" and [b.text for b in page.blocks] == ["a <b>cd", "e f", "g", "h", "1", "2", "3", "4 < 5"]
    assert page.blocks[0].own == ("<p", ".lead", ".foo", ".bar") and page.blocks[3].linked == 1 and "<tr" not in page.blocks[7].around
    for odd in (None, "", "<", "<!--", "<p", "</", "<script>", "<textarea>x", "<a b='", "<p =\"'>x"):
        dom_blocks.read(odd)
    deep = dom_blocks.read("<div>" * 20000 + "x" + "</div>" * 20000 + "y")
    assert [b.text for b in deep.blocks] == ["x", "y"]


def _best_labels(model, page):
    """The best of all labellings of a page, one by one."""
    scores, kinds, n = model.scores(page), main_text.steps(page), len(page.blocks)
    every = [[x >> i & 1 for i in range(n)] for x in range(1 << n)]
    return max(sum(s for s, y in zip(scores, ys) if y) + sum(model.move[k, a, b] for k, a, b in zip(kinds, ys, ys[1:])) for ys in every)


def test_chain_model():
    pages = layouts.labelled_pages(60, 5)
    assert pages == layouts.labelled_pages(60, 5)
    read = [(p, main_text.labels(p, t)) for h, t in pages for p in (dom_blocks.read(h),)]
    names = {f: k for k, f in enumerate(sorted({f for p, _ in read for found in main_text.features(p) for f in found}))}
    batch, rng = main_text._Batch(read, names), np.random.default_rng(1)
    emit, move = rng.normal(0, 0.1, len(names)), rng.normal(0, 0.1, (main_text.STEPS, 2, 2))
    value, by_emit, by_move = batch.gradient(emit, move)
    for k in rng.integers(0, len(names), 5):  # the gradient is the slope of the likelihood
        up = emit.copy()
        up[k] += 1e-5
        assert abs((batch.gradient(up, move)[0] - value) / 1e-5 - by_emit[k]) < 1e-2
    up = move.copy()
    up[1, 0, 1] += 1e-5
    assert abs((batch.gradient(emit, up)[0] - value) / 1e-5 - by_move[1, 0, 1]) < 1e-2
    model = main_text.ChainModel(names, emit, move)
    for page, _ in read[:30]:
        if 0 < len(page.blocks) <= 10:
            ys, scores = model.decode(page), model.scores(page)
            got = scores[ys == 1].sum() + sum(move[k, a, b] for k, a, b in zip(main_text.steps(page), ys, ys[1:]))
            assert abs(got - _best_labels(model, page)) < 1e-9


def test_held_out_layouts():
    model, right, wrong, total = main_text.default_model(), 0, 0, 0
    pages = layouts.labelled_pages(200, 77)
    for html, text in pages:
        page = dom_blocks.read(html)
        off = int((model.decode(page) != main_text.labels(page, text)).sum())
        right, wrong, total = right + (off == 0), wrong + off, total + len(page.blocks)
    assert right > 0.85 * len(pages) and wrong < 0.015 * total


def test_pages_of_another_hand():
    """A page whose layout is not of the maker's: every kind of other text around and inside the article."""
    said = "It was a long way to the town, and nobody knew why. The road went on for miles."
    html = f"""<html><head><title>The long way - Daily</title></head><body><div class="cookie-consent">We use cookies. <button>OK</button></div>
    <header class="site-header"><a href="/">Daily</a><nav><a href="/a">World</a> <a href="/b">Sport</a></nav></header><main><article><h1>The long way</h1><p>{said}</p>
    <div class="ad-slot">{said.upper()}</div><p>Then&nbsp;came <em>rain</em> &amp;   snow.</p><form class="newsletter"><label>Email</label><input><button>Subscribe</button></form><ul><li>First thing to see.</li><li>Second thing to see.</li></ul></article>
    <section class="comments"><h2>2 Comments</h2><div class="comment"><p>{said}</p></div></section></main><aside class="sidebar"><h3>Related</h3><p>{said}</p></aside><footer>&copy; Daily. {said}</footer></body></html>"""
    assert main_text.default_model().text(html) == f"The long way {said} Then came rain & snow. First thing to see. Second thing to see."


def test_extract(spark):
    model = main_text.default_model()
    body = "<html><body><nav><ul><li><a href=/a>A</a></li></ul></nav><article><h1>Title here</h1><p>{}</p></article><footer>x</footer></body></html>"
    long = "Some words go on and on. " * 40000
    rows = [(1, "u", None), (2, "u", ""), (3, None, body.format("A &lt;p&gt; and  more\n text.")), (3, None, body.format("A &lt;p&gt; and  more\n text.")), (4, "v", body.format(long)), (None, "w", "<nav><a href=x>only</a></nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(9).alias("text"), F.lit(8).alias("main_text"), F.lit(7).alias("n_chars"))
    got = main_text.extract(pages, model)
    assert got.columns == ["page_id", "url", "main_text", "n_chars", "text"]
    by = [(r.page_id, r.url, r.text) for r in got.collect()]
    want = "Title here A <p> and more text."
    assert sorted(map(repr, by)) == sorted(map(repr, [(1, "u", ""), (2, "u", ""), (3, None, want), (3, None, want), (4, "v", "Title here " + long.strip()), (None, "w", "")]))
    assert main_text.extract(pages.limit(0), model).count() == 0
    assert main_text.train([]).text("<p>x</p>") == ""
