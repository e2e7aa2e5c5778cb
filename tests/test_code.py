import re

from pyspark.sql import functions as F

from loomwright.operators import code_chunks as K
from loomwright.operators import code_parse as P
from loomwright.plans import fixtures


def test_javascript_chunks_wait_for_closed_braces(spark):
    text = "import a\nfunction f() {\n  function g() {}\n}\nclass B {\n}\nconst h = x => x"
    docs = spark.createDataFrame([(text, "javascript")], "content string, language string")
    assert [(r.start_index, r.end_index) for r in K.chunk_code(docs, language="language").orderBy("chunk_no").collect()] == [(0, 1), (1, 4), (4, 6), (6, 7)]


def test_large_fence_is_cut_and_loses_its_header(spark):
    body = "\n".join(f"line {i:03d} " + "x" * 40 for i in range(60))
    docs = spark.createDataFrame([(f"head\n```go\n{body}\n```\ntail",)], "content string")
    rows = K.chunk_code(docs, most=1000).orderBy("chunk_no").collect()
    assert len(rows) == 3 and rows[0].content.startswith("```go\nline 000") and not any("head" in r.content or "tail" in r.content for r in rows)
    assert (rows[1].start_index, rows[1].end_index) == (5 + 20, 5 + 40)


def test_blank_code_has_no_chunk(spark):
    assert K.chunk_code(spark.createDataFrame([("",), (None,), (" \n",)], "content string")).count() == 0


def test_detection(spark):
    rows = spark.createDataFrame([("def f(): pass", ".JS"), ("def f(): pass", None), ("x => 1", ".zz"), ("public class A", None), ("?", None)], "t string, e string")
    assert [r[0] for r in rows.select(K.detect_language(F.col("t"), F.col("e"))).collect()] == ["javascript", "python", "javascript", "java", "unknown"]


def test_python_entities():
    found = P.python_entities(fixtures.PYTHON)
    assert [(e["name"], e["entity_type"], e["start_line"], e["end_line"]) for e in found] == [("total", "function", 5, 7), ("Store", "class", 11, 18), ("put", "function", 14, 15)]
    assert found[0]["docstring"] == "Sum of two." and found[1]["methods"] == ["put"] and found[1]["decorators"] == ["dataclass"]


def test_javascript_quirks():
    assert P.javascript_entities("function f(){}") == []  # ends on the first line
    assert P.javascript_entities("\nfunction f(a,\n b) {\n}") == []  # parameters on two lines
    assert [e["signature"] for e in P.javascript_entities("let a;\nconst multiply = (x, y) => x * y;")] == ["const multiply = (x, y) =>"]
    assert P.javascript_entities(fixtures.JAVASCRIPT)[0]["docstring"] == "/**\n* Says hello.\n*/"


def test_errors_stay_in_their_row(spark):
    files = spark.createDataFrame(fixtures.SOURCES + [("n.py", "python", None)], "path string, language string, content string")
    rows = {r.path: r for r in P.parse(files).collect()}
    assert rows["src/broken.py"].error.startswith("ParseError") and rows["src/broken.py"].entities == []
    assert rows["src/Main.java"].error is None and rows["n.py"].entities == []


def test_registry():
    registry = P.ParserRegistry()
    registry.register("Toy", lambda s: [{"name": s}])
    assert registry.get("toy")[0]("x") == [{"name": "x"}] and registry.get("tsx") is registry.get("javascript") and registry.get("java") is None
    assert registry.supports_file("a/B.java") and not registry.supports_file("a.txt")


def test_a_source_is_parsed_once(spark):
    rows = spark.createDataFrame([("a.py", "python", "def f(): pass"), ("b.go", "go", "func f() {}"), ("c.py", "python", "def (")], "path string, language string, content string")
    plan = P.entities(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert [(r.path, r.name) for r in P.entities(rows).collect()] == [("a.py", "f")]
    plan = P.imports(rows).select("path", F.explode("imports").alias("i"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_sources_without_a_parser_stay_out_of_python(spark):
    rows = spark.createDataFrame([("JavaScript",), ("tsx",), ("go",), (None,), ("python",)], "language string").withColumn("content", F.lit("x"))
    assert [r[0] for r in rows.select(P._parsable("content", "language", P.DEFAULT)).collect()] == ["x", "x", None, None, "x"]


def test_declarations_as_the_patterns_find_them():
    text = "export  async function a(x) {}\nasync export function b() {}\nexportasync function c(y)\nfunction function d(z)\n// class of class\nexport\ndefault class E extends\nF {}\nletter let constant = 3; var g =\n(a, b) => 1; export const h = i => {}; var let = let => 2"
    for pattern in (P.JS_FUNCTION, P.JS_CLASS, P.JS_ARROW):
        want = [(m.span(), m.groups()) for m in re.finditer(pattern, text)]
        assert want and [(m.span(), m.groups()) for m in P._declared(pattern, text)] == want


def test_docstrings_take_one_parse(spark, tmp_path):
    from loomwright.plans import registry

    spark.createDataFrame([(0, "text")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.code_docstrings(spark, str(tmp_path))
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2  # sources, snippets
    assert rows.count() == 8
