"""The tree data source in batch and as a stream: what is listed, read, pushed and told; and files by name in a store."""

import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull

from loomwright.sources import files, stores, tree_source


@pytest.fixture()
def tree(tmp_path):
    for name, body in {"src/a.py": b"x = 1", "src/b.js": "é".encode("latin-1"), "src/c.PY": b"1", "empty.py": b"", "notes.txt": b"1", "build/d.js": b"1", "e.ts": "λ".encode()}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    for k, name in enumerate(("src/a.py", "src/b.js", "e.ts", "build/d.js")):
        os.utime(tmp_path / name, (1000 + k, 1000 + k))
    return f"file://{tmp_path}"


def test_batch(spark, tree):
    rows = {r.source_id: r for r in tree_source.read_tree(spark, tree, exclude=["build/*"]).collect()}
    assert {k: (r.language, r.size, r.content, r.error) for k, r in rows.items()} == {"src/a.py": ("python", 5, "x = 1", None), "src/b.js": ("javascript", 1, "é", None), "e.ts": ("typescript", 2, "λ", None)}
    assert rows["e.ts"].modified.replace(tzinfo=timezone.utc) == datetime.fromtimestamp(1002, timezone.utc)
    same = {r.source_id: r.content for r in files.code_tree(spark, tree, exclude=["build/*"]).collect()}
    assert same == {k: r.content for k, r in rows.items()}
    assert [r.source_id for r in tree_source.read_tree(spark, tree, languages=["python"]).collect()] == ["src/a.py"]
    assert sorted(r.source_id for r in tree_source.read_tree(spark, tree, since="1970-01-01T00:16:41+00:00").collect()) == ["build/d.js", "e.ts"]
    with pytest.raises(Exception, match="FileNotFound|none-such"):
        tree_source.read_tree(spark, tree + "/none-such").count()


def test_filters_reach_the_listing(spark, tree):
    old = spark.conf.get(tree_source.PUSHDOWN, "false")
    spark.conf.set(tree_source.PUSHDOWN, "true")
    try:
        found = tree_source.read_tree(spark, tree).where("language in ('python', 'typescript') and size > 0")
        assert sorted(r.source_id for r in found.collect()) == ["e.ts", "src/a.py"]
    finally:
        spark.conf.set(tree_source.PUSHDOWN, old)
    reader = tree_source.PushingReader(tree_source._Tree({"root": tree}))
    left = IsNotNull(("language",))
    at = datetime.fromtimestamp(1001, timezone.utc)
    assert list(reader.pushFilters([In(("language",), ("javascript", "typescript")), GreaterThanOrEqual(("modified",), at), left])) == [left]
    assert [n for share in reader.partitions() for n, *_ in share.files] == ["build/d.js", "e.ts", "src/b.js"]
    assert list(reader.pushFilters([GreaterThan(("modified",), at), EqualTo(("extension",), ".ts")])) == []
    assert [n for share in reader.partitions() for n, *_ in share.files] == ["e.ts"]


def test_one_bad_file_is_a_row(spark, tree):
    held = tree_source._Tree({"root": tree})
    share = tree_source.Share([("src/a.py", 5, 0), ("gone.py", 1, 0)])
    (batch,) = held.read(share)
    told = batch.to_pylist()
    assert told[0]["content"] == "x = 1" and told[0]["error"] is None and told[1]["content"] is None and told[1]["error"].startswith("FileNotFoundError")


def test_shares_are_bounded(monkeypatch):
    monkeypatch.setattr(tree_source, "SHARE_BYTES", 10)
    monkeypatch.setattr(tree_source, "SHARE_FILES", 3)
    got = tree_source.shares([(str(k), size, 0) for k, size in enumerate((4, 4, 4, 99, 1, 1, 1, 1))])
    assert [[int(n) for n, *_ in s.files] for s in got] == [[0, 1], [2], [3], [4, 5, 6], [7]]


def test_stream_sees_each_change_once(spark, tree, tmp_path):
    seen = []

    def run():
        rows = tree_source.stream_tree(spark, tree, exclude=["build/*"])
        got = []
        rows.writeStream.foreachBatch(lambda batch, n: got.extend((r.source_id, r.content) for r in batch.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        seen.append(sorted(got))

    run()
    run()
    (tmp_path / "src/z.go").write_text("new")
    (tmp_path / "src/a.py").write_text("x = 2")
    run()
    assert seen == [[("e.ts", "λ"), ("src/a.py", "x = 1"), ("src/b.js", "é")], [], [("src/a.py", "x = 2"), ("src/z.go", "new")]]


def test_files_by_name(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", b"\xff"), ("c.txt", None)], "path string, content binary")
    assert stores.write_files(rows, f"file://{tmp_path}/w") == 2 and stores.write_files(rows.limit(0), f"{tmp_path}/v") == 0
    assert (tmp_path / "w/a/b.txt").read_bytes() == b"\xff" and (tmp_path / "w/c.txt").read_bytes() == b""
    pages = spark.createDataFrame([("u", None, "# T")], "url string, metadata map<string,string>, markdown string")
    assert files.write_markdown(pages, f"file://{tmp_path}/m") == 1 and files.markdown_directory(spark, f"file://{tmp_path}/m").first().metadata == {}
    assert pages.select(F.md5("url")).first()[0] + ".md" == next((tmp_path / "m").iterdir()).name
