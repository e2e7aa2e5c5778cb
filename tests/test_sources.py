import pytest
from pyspark.sql import functions as F

from loomwright.plans import fixtures
from loomwright.sources import files
from loomwright.sources.adapter import CodeTree, NotFound
from loomwright.streaming import incremental


def test_markdown_files(spark, tmp_path):
    for name, text in {"a.md": "---\ntitle: A\nn: 1\n---\n\n# H\nbody\n", "b.md": "no front", "c.md": "---\ntitle: [\n---\nx", "d.md": "---\ntitle: a---b\n---\nbody", "e.txt": "---\na: b\n---\n"}.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "Button.tsx").write_text("export const x = 1")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in files.document_batch(spark, str(tmp_path), str(tmp_path)).collect()}
    assert sorted(rows) == ["Button.tsx", "a.md", "d.md"]
    assert rows["a.md"].metadata == {"title": "A", "n": "1"} and rows["a.md"].content == "# H\nbody"
    assert rows["d.md"].metadata == {"title": "a"} and rows["d.md"].content == "b\n---\nbody"
    assert rows["Button.tsx"].metadata["component"] == "Button"


def test_code_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1")
    (tmp_path / "src" / "latin.js").write_bytes("é".encode("latin-1"))
    (tmp_path / "node_modules" / "p.js").write_text("1")
    (tmp_path / "empty.py").write_text("")
    tree = files.code_tree(spark, str(tmp_path), exclude=["**/node_modules/**"])
    rows = {r.source_id: r for r in tree.collect()}
    assert sorted(rows) == ["src/a.py", "src/latin.js"] and rows["src/latin.js"].content == "é"
    assert "**File:** `src/a.py`" in files.file_documents(tree).where("source_id = 'src/a.py'").first().content
    assert {(r.language, r.files, r.total_files) for r in files.tree_stats(tree).collect()} == {("python", 1, 2), ("javascript", 1, 2)}
    assert files.code_tree(spark, str(tmp_path), since="2200-01-01T00:00:00").count() == 0


def test_trees_are_listed_by_tasks(spark, tmp_path):
    for name in ("a.py", "deep/er/b.js", "deep/__init__.py", "deep/c.txt", "deep/empty.py", "x/B.tsx"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if "empty" in name else name)
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        tree = files.code_tree(spark, root)
        assert {r.source_id: r.content for r in tree.collect()} == {n: n for n in ("a.py", "deep/er/b.js", "deep/__init__.py", "x/B.tsx")}
        assert tree.inputFiles() == [] and files.tree_listing(spark, root).inputFiles() == []  # no file index, which the driver would hold
        assert files.tsx_directory(spark, f"{root.rstrip('/')}/x").inputFiles() == []
        assert {r.path for r in tree.where("extension = '.tsx'").collect()} == {f"file:{tmp_path}/x/B.tsx"}
    one = files.code_tree(spark, str(tmp_path / "a.py"))  # a file is no folder to walk: Spark's own listing
    assert [r.content for r in one.collect()] == ["a.py"]


def test_write_markdown(spark, tmp_path):
    pages = spark.createDataFrame([("https://a/b", {"title": "T"}, "# T")], "url string, metadata map<string,string>, markdown string")
    assert files.write_markdown(pages, str(tmp_path)) == 1
    assert files.markdown_directory(spark, str(tmp_path)).first().metadata == {"title": "T"}


def test_changed_pages_stream(spark, tmp_path):
    pages = tmp_path / "pages"
    put = lambda rows: spark.createDataFrame(rows, "url string, html string, crawled_at string").selectExpr("url", "html", "cast(crawled_at as timestamp) crawled_at").coalesce(1).write.mode("append").parquet(str(pages))
    seen = []
    for day, rows in enumerate([[("a", "1"), ("b", "1")], [("a", "1"), ("b", "2")]]):
        put([(*r, f"2024-01-0{day + 1} 00:00:00") for r in rows])
        stream = incremental.stream_files(spark, str(pages), "url string, html string, crawled_at timestamp")
        incremental.changed_pages(stream, lambda batch, n: seen.extend((r.url, r.html) for r in batch.collect()), str(tmp_path / "check")).awaitTermination()
    assert sorted(seen) == [("a", "1"), ("b", "1"), ("b", "2")]


def test_adapter(spark, tmp_path):
    (tmp_path / "a.py").write_text(fixtures.PYTHON)
    (tmp_path / "b.js").write_text(fixtures.JAVASCRIPT)
    (tmp_path / "c.py").write_text("def broken(:")
    with CodeTree(spark, str(tmp_path)) as tree:
        assert [r.source_id for r in tree.ids().collect()] == ["a.py", "b.js", "c.py"] and tree.ids(["python"], 1).count() == 1
        assert tree.fetch("b.js").first().language == "javascript"
        ids = [r.source_id for r in tree.entities().collect()]
        assert len(ids) == len(set(ids)) == 7 and "a.py::total" in ids
        with pytest.raises(NotFound):
            tree.fetch("d.py")
    with pytest.raises(NotFound), CodeTree(spark, str(tmp_path / "none")):
        pass


def test_markdown_folder_is_listed_and_read_by_tasks(spark, tmp_path):
    names = ["a.md", "b c#1%.md", "d\u00e9.md", "e.txt", "_f.md", "_g=1.md", ".h.md", "sub/i.md", "_sub/j.md", "sub/[k]{l}.md", "empty.md"]
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("" if name == "empty.md" else f"---\ntitle: T{names.index(name)}\n---\n\ntext \u00e9 {name}\n")
    for recursive in (False, True):
        read = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", str(recursive).lower()).text(f"file://{tmp_path}", wholetext=True)
        want = files.parse_frontmatter(read.select(F.col("_metadata.file_path").alias("path"), "value")).orderBy("path").collect()
        got = files.markdown_directory(spark, f"file://{tmp_path}", recursive)
        assert len(want) == (6 if recursive else 4) and got.orderBy("path").collect() == want
        assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1  # frontmatter is read once
        assert got.inputFiles() == []  # Spark's reader lists names on the driver, and makes a task of some 32 files
