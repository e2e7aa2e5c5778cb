"""Functions, classes and imports of source code, and their documents.

Parsing is Arrow-batched Python over the standard library's syntax tree and
regular expressions; everything that formats entities is expressions.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as T

ENTITY = "struct<name:string,entity_type:string,content:string,docstring:string,start_line:int,end_line:int,signature:string,parameters:array<string>,return_type:string,decorators:array<string>,parent:string,methods:array<string>>"
PARSED = f"struct<entities:array<{ENTITY}>,error:string>"
_FIELDS = ("name", "entity_type", "content", "docstring", "start_line", "end_line", "signature", "parameters", "return_type", "decorators", "parent", "methods")

#: Languages by extension in the parser registry, and languages that share a parser.
EXTENSIONS = {
    ".py": "python", ".pyw": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php",
    ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".cs": "csharp",
}
FAMILIES = {"javascript": "javascript", "typescript": "javascript", "jsx": "javascript", "tsx": "javascript"}
#: The patterns of JavaScript declarations and imports.
JS_FUNCTION = r"(export\s+)?(async\s+)?function\s+(\w+)\s*\((.*?)\)"
JS_CLASS = r"(export\s+)?(default\s+)?class\s+(\w+)(\s+extends\s+\w+)?"
JS_ARROW = r"(export\s+)?(const|let|var)\s+(\w+)\s*=\s*(\(.*?\)|[\w]+)\s*=>"
JS_IMPORT = r"import\s+.*?from\s+[\"'].*?[\"']"
JS_REQUIRE = r"(const|let|var)\s+.*?=\s*require\([\"'].*?[\"']\)"
#: Words of which each declaration has one, and those that may stand before it in this order, as its pattern has them.
JS_WORDS = {JS_FUNCTION: (("function",), ("export", "async")), JS_CLASS: (("class",), ("export", "default")), JS_ARROW: (("const", "let", "var"), ("export",))}


def _entity(**known) -> dict:
    return {f: known.get(f) for f in _FIELDS}


def python_entities(source: str) -> list[dict]:
    """Plain functions and classes, breadth first; raises SyntaxError.  Async functions are not among them and methods have no parent."""
    lines, out = source.split("\n"), []
    for node in ast.walk(ast.parse(source)):
        if not isinstance(node, (ast.FunctionDef, ast.ClassDef)):
            continue
        marks = [ast.unparse(d) if not isinstance(d, ast.Call) else ast.unparse(d.func) for d in node.decorator_list] or None
        base = {"name": node.name, "content": "\n".join(lines[node.lineno - 1 : node.end_lineno]), "docstring": ast.get_docstring(node), "start_line": node.lineno, "end_line": node.end_lineno, "decorators": marks}
        if isinstance(node, ast.FunctionDef):
            names, returns = [a.arg for a in node.args.args], ast.unparse(node.returns) if node.returns else None
            out.append(_entity(**base, entity_type="function", parameters=names, return_type=returns, signature=f"def {node.name}({', '.join(names)})" + (f" -> {returns}" if returns else "")))
        else:
            bases = ", ".join(map(ast.unparse, node.bases))
            out.append(_entity(**base, entity_type="class", signature=f"class {node.name}" + (f"({bases})" if bases else ""), methods=[x.name for x in node.body if isinstance(x, ast.FunctionDef)] or None))
    return out


def python_imports(source: str) -> list[str]:
    """One line an imported module, one a from-import; none if the source does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [f"import {a.name}" for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append(f"from {node.module or ''} import {', '.join(a.name for a in node.names)}")
    return out


def _closing_line(source: str, begin: int) -> int | None:
    """Line, from 0, of the brace that closes the first one after begin; quotes of three kinds hide braces."""
    depth, quote = 0, ""
    for m in re.compile(r"[\"'`{}]").finditer(source, begin):
        c, at = m[0], m.start()
        if c in "\"'`":
            if at and source[at - 1] == "\\":
                continue
            quote = c if not quote else "" if quote == c else quote
        elif not quote:
            depth += 1 if c == "{" else -1
            if c == "}" and depth == 0:
                return source.count("\n", 0, at)
    return None


def _doc_above(lines: list[str], line: int) -> str | None:
    """The /** comment that ends above the line, past blank lines and // comments."""
    at = line - 1
    while at >= 0 and (not (bare := lines[at].strip()) or (bare.startswith("//") and not bare.endswith("*/"))):
        at -= 1
    if at < 0 or not lines[at].strip().endswith("*/"):
        return None
    for top in range(at - 1, -1, -1):
        if lines[top].strip().startswith("/**"):
            return "\n".join(x.strip() for x in lines[top : at + 1])
    return None


def _js_parameters(inside: str) -> list[str] | None:
    names = (re.sub(r"[:=].*", "", p.strip()).strip() for p in inside.split(","))
    return [n for n in names if n] or None


def _declared(pattern: str, source: str) -> Iterator[re.Match]:
    """The matches of re.finditer, tried only where one of the pattern's words stands, with what may stand before it."""
    words, leads = JS_WORDS[pattern]
    whole, done = re.compile(pattern), 0
    places = {w: at for w in words if (at := source.find(w)) >= 0}
    while places:
        word = min(places, key=places.get)
        start = at = places[word]
        if at >= done:
            for lead in reversed(leads):
                end = start
                while end > done and source[end - 1].isspace():
                    end -= 1
                if end < start and end - len(lead) >= done and source.endswith(lead, done, end):
                    start = end - len(lead)
            if found := whole.match(source, start):
                yield found
                done = found.end()
        places[word] = source.find(word, max(at + 1, done))
        if places[word] < 0:
            del places[word]


def javascript_entities(source: str) -> list[dict]:
    """Function declarations, then classes, then arrow functions.  An end on the first line counts as none, so such entities are left out."""
    lines, out = source.split("\n"), []

    def put(m: re.Match, end: int | None, kind: str, signature: str, parameters: list[str] | None) -> None:
        if end:
            start = source.count("\n", 0, m.start())
            out.append(_entity(name=m[3], entity_type=kind, content="\n".join(lines[start : end + 1]), docstring=_doc_above(lines, start), start_line=start + 1, end_line=end + 1, signature=signature, parameters=parameters))

    for m in _declared(JS_FUNCTION, source):
        put(m, _closing_line(source, m.end()), "function", ("export " if m[1] else "") + ("async " if m[2] else "") + f"function {m[3]}({m[4]})", _js_parameters(m[4]))
    for m in _declared(JS_CLASS, source):
        put(m, _closing_line(source, m.end()), "class", ("export " if m[1] else "") + ("default " if m[2] else "") + f"class {m[3]}{m[4] or ''}", None)
    for m in _declared(JS_ARROW, source):
        inside = m[4].strip("()")
        if re.compile(r"\s*\{").match(source, m.end()):
            end = _closing_line(source, m.end())
        else:
            stop = re.compile(r"[;\n]").search(source, m.end())
            end = source.count("\n", 0, stop.start()) if stop else len(lines) - 1
        put(m, end, "function", ("export " if m[1] else "") + f"const {m[3]} = ({inside}) =>", _js_parameters(inside))
    return out


def javascript_imports(source: str) -> list[str]:
    return [m[0] for p in (JS_IMPORT, JS_REQUIRE) for m in re.finditer(p, source)]


def snippet_docstring(source: str, language: str) -> str | None:
    if FAMILIES.get(language, language) == "javascript":
        lines = source.split("\n")
        return _doc_above(lines, len(lines) - 1)
    try:
        return ast.get_docstring(ast.parse(source))
    except (SyntaxError, ValueError):
        return None


def snippet_docs(rows: DataFrame, content: str = "content", language: str = "language", out: str = "doc") -> DataFrame:
    """rows with the documentation that a snippet itself begins with, or null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, languages in batches:
            yield pd.Series([None if s is None or n is None else snippet_docstring(s, n) for s, n in zip(sources, languages)], dtype=object)

    return rows.withColumn(out, run(F.col(content), F.col(language)))


class ParserRegistry:
    """Parsers by language family: (entities, imports) functions."""

    def __init__(self):
        self._parsers: dict[str, tuple[Callable, Callable]] = {"python": (python_entities, python_imports), "javascript": (javascript_entities, javascript_imports)}

    def register(self, language: str, entities: Callable[[str], list[dict]], imports: Callable[[str], list[str]] = lambda source: []) -> None:
        self._parsers[language.lower()] = (entities, imports)

    def get(self, language: str) -> tuple[Callable, Callable] | None:
        name = language.lower()
        return self._parsers.get(name) or self._parsers.get(FAMILIES.get(name, name))

    def parsed(self) -> list[str]:
        """All names that `get` has a parser for, in lower case."""
        return sorted({*self._parsers, *(n for n, family in FAMILIES.items() if family in self._parsers)})

    def languages(self) -> list[str]:
        return sorted({*self._parsers, "typescript"})

    @staticmethod
    def supports_file(path: str) -> bool:
        """Whether the extension is known, be there a parser or not."""
        return ("." + path.rsplit(".", 1)[-1].lower() if "." in path else "") in EXTENSIONS


DEFAULT = ParserRegistry()


def language_of(path: Column, extensions: dict[str, str] = EXTENSIONS) -> Column:
    pairs = [x for e, lang in extensions.items() for x in (F.lit(e), F.lit(lang))]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def _parsable(content: str, language: str, registry: ParserRegistry) -> Column:
    """Sources that have a parser; null for others."""
    return F.when(F.lower(language).isin(registry.parsed()), F.col(content))


def parse(files: DataFrame, content: str = "content", language: str = "language", registry: ParserRegistry = DEFAULT) -> DataFrame:
    """files with `entities` and `error`: a source that does not parse has an error, an unsupported language neither.

    Sources without a parser stay out of Python, and the function counts as nondeterministic, else what is asked of its result parses anew.
    """

    @F.pandas_udf(PARSED)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for sources, languages in batches:
            found = []
            for source, name in zip(sources, languages):
                parser = registry.get(name) if name else None
                try:
                    found.append(([] if parser is None or source is None else parser[0](source), None))
                except (SyntaxError, ValueError, RecursionError) as e:
                    found.append(([], f"ParseError: {e}"))
            yield pd.DataFrame(found, columns=["entities", "error"])

    return files.withColumn("parsed", run.asNondeterministic()(_parsable(content, language, registry), language)).select(*files.columns, "parsed.entities", "parsed.error")


def imports(files: DataFrame, content: str = "content", language: str = "language", registry: ParserRegistry = DEFAULT) -> DataFrame:
    """files with `imports`, an array of import statements."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sources, languages in batches:
            yield pd.Series([(registry.get(n) or (None, lambda s: []))[1](s) if n and s is not None else [] for s, n in zip(sources, languages)], dtype=object)

    return files.withColumn("imports", run.asNondeterministic()(_parsable(content, language, registry), language))


def entities(files: DataFrame, path: str = "path", **how) -> DataFrame:
    """A row an entity, with path and language; files with errors have none."""
    return parse(files, **how).select(F.col(path).alias("path"), "language", F.posexplode("entities").alias("entity_no", "e")).select("path", "language", "entity_no", "e.*")


def entity_documents(rows: DataFrame) -> DataFrame:
    """Entities as documents: source_id, title, content in markdown, and metadata as columns."""
    named = F.when(F.coalesce("parent", F.lit("")) != "", F.concat("parent", F.lit("::"), "name")).otherwise(F.col("name"))
    titled = F.when(F.coalesce("parent", F.lit("")) != "", F.concat("parent", F.lit("."), "name")).otherwise(F.col("name"))

    def part(present: Column, *lines: Column | str) -> Column:
        return F.when(present, F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in lines)))

    def listed(c: str, head: str, form: str) -> Column:
        return part(F.coalesce(F.size(c), F.lit(0)) > 0, head, F.array_join(F.transform(c, lambda p: F.format_string(form, p)), "\n"), "")

    def filled(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) != ""

    content = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), "name"),
        F.lit(""),
        part(filled("signature"), F.format_string("**Signature:** `%s`", "signature"), ""),
        part(filled("docstring"), "## Documentation", "", F.col("docstring"), ""),
        listed("parameters", "**Parameters:**", "- `%s`"),
        part(filled("return_type"), F.format_string("**Returns:** `%s`", "return_type"), ""),
        listed("decorators", "**Decorators:**", "- `@%s`"),
        F.lit("## Source Code"),
        F.lit(""),
        F.concat(F.lit("```"), "language"),
        F.col("content"),
        F.lit("```"),
    )
    return rows.select(
        F.concat("path", F.lit("::"), named).alias("source_id"),
        F.concat(T.capitalize(F.col("entity_type")), F.lit(": "), titled).alias("title"),
        content.alias("content"),
        F.col("path").alias("file_path"),
        F.col("language").alias("programming_language"),
        "entity_type",
        F.col("name").alias("entity_name"),
        "signature",
        F.array_join("parameters", ",").alias("parameters"),
        "return_type",
        F.array_join("decorators", ",").alias("decorators"),
        F.col("parent").alias("parent_entity"),
        F.array_join("methods", ",").alias("methods"),
        filled("docstring").alias("has_docstring"),
        "start_line",
        "end_line",
    )
