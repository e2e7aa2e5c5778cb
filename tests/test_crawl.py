from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import crawl, html


def test_page_parts():
    page = html.parse("<html><head><title> A &amp; B </title><meta name='x' content='y'></head><body><nav><a href='/n'>n</a></nav><script>var a='</p>';</script><article><h1>T<b>x</h1><p>one <a href='b#c'>two</a><pre>code\n  x</pre></article><footer>f</footer></body></html>")
    assert page.title.strip() == "A & B" and page.metas == {"x": "y"} and page.links == ["/n", "b#c"]
    assert page.markdown() == "# Tx\n\none [two](b#c)\n\n[code]\ncode\n  x\n[/code]"


def test_references_that_are_cut():
    text = "<title>a &amp;&amp</title><article><h1>a &amp;&amp</h1><p>&lt;b&gt &#65; &#65 &amp;lt; &nosuch;<a href='/x?a=1&amp=2&b=3'>l</a></article>"
    page = html.parse(text, closed=True)
    assert page.title == "a &&amp" and page.markdown() == "# a &&amp\n\n<b&gt A &#65 &lt; &nosuch;[l](/x?a=1&amp=2&b=3)"
    assert page.links == ["/x?a=1&amp=2&b=3"]
    assert html.parse(text).title == "a &&"  # as browsers read it


def test_pages_agree_with_their_sql(spark, tmp_path):
    import duckdb

    from loomwright.plans import registry

    cut = "<html><head><title>a &amp;&amp</title></head><body><article><h1>a &amp;&amp</h1><p>" + "word " * 30 + "</p></article><div class=\"ad\">x &lt</div></body></html>"
    spark.createDataFrame([(1, "https://a.b/c", cut)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("page_meta", "page_custom", "page_min_content", "html_markdown"):
        got = registry.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
        assert [tuple(r) for r in got.collect()] == want, name


def test_titles_are_trimmed_and_missing_as_in_their_sql(spark, tmp_path):
    import duckdb

    from loomwright.plans import registry

    page = "<html><head><title>{0}</title></head><body><article><h1>{0}</h1><p>w</p></article><div class=\"ad\">{0}</div></body></html>"
    titles = [" a b ", "\n a\t", "a\r\n", "\u00a0a\u3000", "\u2028a\x85", "a\x1c ", " \n ", "", "\u2003"]
    pages = [page.format(t) for t in titles] + ["", None, "<html><body><article><p>w</p></article></body></html>"]
    spark.createDataFrame([(i, f"https://a.b/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("page_meta", "page_custom"):
        got = registry.queries()[name](spark, str(tmp_path)).orderBy("page_id")
        want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({registry.oracle_sql()[name]}) ORDER BY page_id").fetchall()
        assert [tuple(r) for r in got.collect()] == want, name


def test_state_of_shared_urls_and_missing_pages_as_in_its_sql(spark, tmp_path):
    import duckdb

    from loomwright.plans import registry

    pages = [(i, f"https://a.b/{i % 40 if i % 7 else i}", None if i % 11 == 5 else f"<p>{i * 7919 % 101}") for i in range(400)]
    pages += [(400 + i, f"https://c.d/{i % 5}", "<p>same") for i in range(60) if i % 3 == 0]  # ids of remainder 1, all unchanged or stale
    pages += [(500 + i, None, "<p>x") for i in range(4)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")  # its ORDER BY leaves ties open; so they fall as the rows stand
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("crawl_diff", "state_upsert"):
        got = registry.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
        assert Counter(tuple(r) for r in got.collect()) == Counter(want), name


def test_globs(spark):
    urls = ["https://a.b/c", "http://a.b/c.pdf", None]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(crawl.allowed(F.col("u"), ["a.b"], ["http*"], ["*.pdf"])).collect()
    assert [r[0] for r in rows][:2] == [True, False]


def test_path_globs(spark):
    paths = ["/r/node_modules/p.js", "/r/node_modules/a/b.js", "/r/src/x.test.js"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(F.col("p").rlike(T.path_pattern("**/node_modules/**"))).collect()] == [True, False, False]
    assert [r[0] for r in df.select(F.col("p").rlike(T.path_pattern("**/*.test.*"))).collect()] == [False, False, True]


def test_due(spark):
    now = F.lit("2024-06-10 00:00:00").cast("timestamp")
    state = spark.createDataFrame([("b", "h", datetime(2024, 6, 9)), ("c", "h", datetime(2024, 6, 2)), ("d", "x", datetime(2024, 6, 9))], "url string, content_hash string, last_crawled timestamp")
    pages = spark.createDataFrame([("a", "h"), ("b", "h"), ("c", "h"), ("d", "h")], "url string, content_hash string")
    assert [r.reason for r in crawl.due(pages, state, now, 7).orderBy("url").collect()] == ["new", "unchanged", "stale", "changed"]


def test_reachable_takes_the_shortest_way(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("c", "a")], "url string, target string")
    rows = crawl.reachable(links, spark.createDataFrame([("a",)], "url string"), 2)
    assert {(r.url, r.depth) for r in rows.collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}


def test_sources(spark, tmp_path):
    own = crawl.Sources()
    own.add("x", "https://a.b", ["a.b"])
    own.add("x", "https://a.b/2", ["a.b"])
    assert own.table(spark).count() == 1 and own.remove("x") and not own.remove("x") and own.table(spark).count() == 0
    (tmp_path / "c.yaml").write_text("sources:\n- {name: y, start_url: 'https://y', allowed_domains: [y]}\n")
    pages = spark.createDataFrame([("https://y/1",), ("https://z/1",)], "url string")
    assert [r.source for r in crawl.allowed_by(pages, crawl.Sources.load(str(tmp_path / "c.yaml")).table(spark)).collect()] == ["y"]


def test_state_file(spark, tmp_path):
    (tmp_path / "state.json").write_text('{"u": {"content_hash": "h", "last_crawled": "2024-01-01T00:00:00", "output_file": "f.md", "metadata": {"a": "b"}}}')
    assert crawl.read_state(spark, str(tmp_path / "state.json")).first().content_hash == "h"
    assert crawl.read_state(spark, str(tmp_path / "none")).count() == 0


def test_crawl_end_to_end(spark):
    body = "<article><p>" + "word " * 40 + "</p></article>"
    pages = spark.createDataFrame([("https://a/x", body), ("https://a/y", "<p>short</p>"), ("https://a/z", None)], "url string, html string")
    empty = spark.createDataFrame([], "url string, content_hash string, last_crawled timestamp, output_file string, metadata map<string,string>")
    now = F.lit("2024-06-10 00:00:00").cast("timestamp")
    stored, state, _ = crawl.crawl(pages, empty, now)
    assert [r.url for r in stored.collect()] == ["https://a/x"]
    again, _, _ = crawl.crawl(pages, state, now)
    assert again.count() == 0


def test_links_of_short_and_unchanged_pages_and_settings(spark, tmp_path):
    body = "<h1>Big <i>one</i></h1><a href='/y#top'>y</a><p>" + "word " * 40 + "</p><aside>kept</aside>"
    pages = spark.createDataFrame([("https://a/x", body), ("https://a/s", "<a href='z'>z</a>")], "url string, html string")
    state = spark.createDataFrame([], "url string, content_hash string, last_crawled timestamp, output_file string, metadata map<string,string>")
    now = F.lit("2024-06-10 00:00:00").cast("timestamp")
    stored, state, links = crawl.crawl(pages, state, now, selectors={"top": "h1", "none": ".x"}, removed=("aside",))
    row = stored.first()
    assert row.metas["top"] == "Big one" and "none" not in row.metas and "kept" not in row.markdown
    again, _, same = crawl.crawl(pages, state, now, removed=("aside",))
    assert again.count() == 0 and sorted(map(tuple, links.collect())) == sorted(map(tuple, same.collect())) == [("https://a/s", "https://a/z"), ("https://a/x", "https://a/y")]
    (tmp_path / "c.yaml").write_text("sources: []\nincremental: {force_recrawl_after_days: 3, hash_algorithm: md5}\nextraction: {min_content_length: 7}\nother: 1\n")
    own = crawl.Sources.load(str(tmp_path / "c.yaml"))
    assert own.settings["days"] == 3 and own.settings["algorithm"] == "md5" and own.settings["least_length"] == 7 and own.settings["enabled"]
    own.add("x", "https://x")
    own.save(str(tmp_path / "c.yaml"))
    assert crawl.Sources.load(str(tmp_path / "c.yaml")).rows["x"]["max_depth"] == 3 and "other: 1" in (tmp_path / "c.yaml").read_text()
    state.write.parquet(str(tmp_path / "state"))
    assert crawl.clear_state(spark, str(tmp_path / "state")) and not crawl.clear_state(spark, str(tmp_path / "state")) and crawl.read_state(spark, str(tmp_path / "state")).count() == 0
