"""Source code chunking: fenced blocks, definitions, or line counts.

Fences, Python definitions and line counts are expressions; JavaScript needs the brace depth
before each line and is an Arrow function.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.functions.udf import arrow_function

#: Languages by file extension that content detection knows.
CONTENT_EXTENSIONS = {
    ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python",
    ".java": "java", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php",
}
FENCE = r"(?sU)```(\w*)\n(.*?)```"
PIECE = "array<struct<content:string,start_index:int,end_index:int>>"


def detect_language(text: Column, extension: Column | None = None) -> Column:
    """By extension where it is known, else by tell-tale strings, else unknown."""
    said = F.lit(None).cast("string")
    if extension is not None:
        pairs = [x for e, lang in CONTENT_EXTENSIONS.items() for x in (F.lit(e), F.lit(lang))]
        said = F.try_element_at(F.create_map(*pairs), F.lower(F.coalesce(extension, F.lit(""))))
    told = (
        F.when(F.contains(text, F.lit("def ")) & F.contains(text, F.lit(":")), "python")
        .when(F.contains(text, F.lit("function ")) | F.contains(text, F.lit("const ")) | F.contains(text, F.lit("=>")), "javascript")
        .when(F.contains(text, F.lit("public class ")) | F.contains(text, F.lit("private class ")), "java")
        .otherwise("unknown")
    )
    return F.coalesce(said, told)


def _lines_of(text: Column, lines: Column, most: int) -> Column:
    """Lines of a chunk: at least 10, else as many average lines as fit; 10 for a text without characters."""
    return F.greatest(F.lit(10), F.coalesce(F.floor(F.try_divide(F.lit(float(most)), F.length(text) / F.size(lines))), F.lit(10))).cast("int")


def by_lines(text: Column, most: int) -> Column:
    """Runs of equally many lines with their line numbers; blank runs are dropped."""

    def cut(lines: Column, n: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(lines) - 1, n)
        made = F.transform(starts, lambda s: F.struct(F.array_join(F.slice(lines, s + 1, n), "\n").alias("content"), s.cast("int").alias("start_index"), F.least(s + n, F.size(lines)).cast("int").alias("end_index")))
        return F.filter(made, lambda c: T.filled(c["content"])).cast(PIECE)

    return T.let(F.split(text, "\n", -1), lambda lines: T.let(_lines_of(text, lines, most), lambda n: cut(lines, n)))


def python_definitions(text: Column) -> Column:
    """A chunk from each line that begins `def ` or `class `, whatever its indent, to the next; offsets are line numbers."""
    pieces = F.split(text, r"(?U)\n(?=[^\S\n]*(?:def |class ))", -1)

    def placed(ps: Column) -> Column:
        lines = F.transform(ps, lambda p: (T.count_of(p, "\n") + 1).cast("int"))
        made = F.zip_with(F.zip_with(ps, lines, lambda p, n: F.struct(p.alias("p"), n.alias("n"))), T.offsets(lines), lambda p, at: F.struct(p["p"].alias("content"), at.alias("start_index"), (at + p["n"]).alias("end_index")))
        return F.filter(made, lambda c: T.filled(c["content"])).cast(PIECE)

    return T.let(pieces, placed)


def fenced(text: Column, most: int) -> Column:
    """A chunk a fence; what precedes the first goes with it, what follows a fence is dropped.

    A chunk above the greatest size is cut by lines, fenced again piece by piece, and loses the header.
    """
    whole, lang, code = (F.regexp_extract_all(text, F.lit(FENCE), F.lit(g)) for g in (0, 1, 2))
    items = F.arrays_zip(F.split(text, FENCE, -1).alias("gap"), whole.alias("whole"), lang.alias("lang"), code.alias("code"))

    def chunk(m: Column, start: Column, i: Column) -> Column:
        end = start + F.length(m["whole"])
        name = F.when(m["lang"] == "", "unknown").otherwise(m["lang"])
        header = T.strip(m["gap"])

        def of_body(body: Column) -> Column:
            fence = F.concat(F.lit("```"), name, F.lit("\n"), body, F.lit("\n```"))
            content = F.when((i == 0) & (header != ""), F.concat(header, F.lit("\n\n"), fence)).otherwise(fence)
            one = F.array(F.struct(content.alias("content"), start.cast("int").alias("start_index"), end.cast("int").alias("end_index")))
            cut = T.let(F.split(body, "\n", -1), lambda lines: T.let(_lines_of(body, lines, most), lambda n: F.transform(
                F.sequence(F.lit(0), F.size(lines) - 1, n),
                lambda s: F.struct(F.concat(F.lit("```"), name, F.lit("\n"), F.array_join(F.slice(lines, s + 1, n), "\n"), F.lit("\n```")).alias("content"), (start + s).cast("int").alias("start_index"), (start + F.least(s + n, F.size(lines))).cast("int").alias("end_index")),
            )))
            return F.when(F.length(content) > most, cut.cast(PIECE)).otherwise(one.cast(PIECE))

        return T.let(T.strip(m["code"]), of_body)

    def placed(ms: Column) -> Column:
        at = T.offsets(F.transform(ms, lambda m: F.length(m["gap"]) + F.length(m["whole"])))
        begun = F.zip_with(ms, at, lambda m, a: F.struct(m.alias("m"), (a + F.length(m["gap"])).alias("start")))
        return F.flatten(F.transform(begun, lambda b, i: chunk(b["m"], b["start"], i)))

    # What follows the last fence has no match beside it and is dropped.
    return T.let(F.filter(items, lambda m: m["whole"].isNotNull()), placed)


def _javascript(text: str) -> list[dict]:
    """Chunks that begin at definitions outside all braces."""
    lines, out, begin, depth = text.split("\n"), [], 0, 0
    starters = ("function ", "class ", "export function ", "export class ")

    def put(upto: int) -> None:
        body = "\n".join(lines[begin:upto])
        if body.strip():
            out.append({"content": body, "start_index": begin, "end_index": upto})

    for at, line in enumerate(lines):
        bare = line.strip()
        if at > begin and depth == 0 and (bare.startswith(starters) or (bare.startswith("const ") and "=>" in line)):
            put(at)
            begin = at
        depth += line.count("{") - line.count("}")
    put(len(lines))
    return out or [{"content": text, "start_index": 0, "end_index": len(text)}]


@arrow_function("array<struct<content:string,start_index:int,end_index:int>>")
def javascript_definitions(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield series.map(lambda t: [] if t is None else _javascript(t))


def chunk_code(docs: DataFrame, content: str = "content", language: str | None = None, extension: str | None = None, most: int = 1500) -> DataFrame:
    """A row a chunk: the document's other columns, language, chunk_no, content, start_index, end_index.

    Fenced text is cut at fences, Python and JavaScript or TypeScript at definitions,
    other code by lines.  Offsets are characters on the fenced path and lines elsewhere.  Blank and null texts have no chunk.
    """
    text = F.col(content)
    given = F.col(language) if language else F.lit(None).cast("string")
    known = F.when(given.isNull() | (given == "unknown"), detect_language(text, F.col(extension) if extension else None)).otherwise(given)
    others = [c for c in docs.columns if c not in (content, "language")]
    docs = docs.where(T.filled(text)).select(*others, text.alias("code_text"), known.alias("language"))
    is_fenced = F.col("code_text").rlike(r"(?U)```\w*\n")
    whole = F.array(F.struct(F.col("code_text").alias("content"), F.lit(0).alias("start_index"), F.length("code_text").alias("end_index"))).cast(PIECE)
    script = F.col("language").isin("javascript", "typescript")
    jvm = docs.where(is_fenced | ~script)
    found = F.when(is_fenced, fenced(F.col("code_text"), most)).when(F.col("language") == "python", python_definitions(F.col("code_text"))).otherwise(by_lines(F.col("code_text"), most))
    jvm = jvm.withColumn("pieces", T.let(found, lambda f: F.when((F.size(f) == 0) & (is_fenced | (F.col("language") == "python")), whole).otherwise(f)))
    py = docs.where(~is_fenced & script).withColumn("pieces", javascript_definitions("code_text"))
    both = jvm.unionByName(py)
    return both.select(*others, "language", F.posexplode("pieces").alias("chunk_no", "piece")).select(*others, "language", "chunk_no", F.lit("code").alias("chunk_type"), "piece.*")
