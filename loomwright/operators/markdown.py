"""Markdown chunking as row-wise expressions: no shuffle, no Python.

A document becomes an array of sections, a section an array of text and code
blocks, and a fold over the blocks packs them into chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators.scan import running

#: A heading line: one to six #, white space, something.
HEADING = r"(?mdU)^(#{1,6})[^\S\n]+(.+)$"
CODE = r"(?s)\[code\](.*?)\[/code\]"
_S, _H, _E = "\u0001", "\u0002", "\u0003"


@dataclass(frozen=True)
class ChunkSizes:
    """Least and greatest size of a chunk in characters; overlap is accepted and has no effect."""

    least: int = 200
    most: int = 1500
    overlap: int = 100

    def __post_init__(self):
        if self.least <= 0 or self.most <= 0 or self.least >= self.most:
            raise ValueError("sizes must be positive, the least below the greatest")


def sections(text: Column) -> Column:
    """Array of (section_no, heading, level, content).

    What precedes the first heading is a section of level 0 without heading.  A section needs a
    line of its own, be it blank, so a heading right before another vanishes.
    """
    marked = F.regexp_replace(text, HEADING, f"{_S}$1{_H}$2{_E}")
    parts = F.split(marked, _S, -1)
    last = F.size(parts) - 1

    def section(part: Column, i: Column) -> Column:
        is_heading = i > 0
        rest = F.when(is_heading, F.substring_index(part, _E, -1)).otherwise(part)
        # The line end that leads to the next heading closes a part's last line.
        has_lines = F.when(is_heading, F.when(i < last, F.length(rest) >= 2).otherwise(F.length(rest) >= 1)).otherwise((last == 0) | (rest != ""))
        level = F.when(is_heading, F.length(F.substring_index(part, _H, 1))).otherwise(0)
        heading = F.when(is_heading, T.strip(F.substring_index(F.substring_index(part, _E, 1), _H, -1)))
        return F.struct(i.alias("section_no"), heading.alias("heading"), level.alias("level"), T.strip(rest).alias("content"), has_lines.alias("has_lines"))

    kept = F.filter(F.transform(parts, section), lambda s: s["has_lines"])
    return F.transform(kept, lambda s, i: F.struct(i.alias("section_no"), s["heading"].alias("heading"), s["level"].alias("level"), s["content"].alias("content")))


def section_rows(pieces: DataFrame, group: str, order: list[str], text: str = "content", tasks: int | None = None) -> DataFrame:
    """(group, order, section_no, heading, level, content) of documents whose pieces are rows, numbered through each document.

    Every piece begins with a heading and is followed by a line end, as the turns of a conversation are; then a document's sections are
    its pieces' sections, and their numbers a running sum of how many the earlier pieces have, whatever a document's size.
    """
    found = pieces.select(group, *order, sections(F.concat(F.col(text), F.lit("\n"))).alias("found"))
    numbered = running(found, group, order, {"first": F.size("found")}, tasks)
    each = numbered.select(group, *order, "first", F.explode("found").alias("s"))
    return each.select(group, *order, (F.col("first") + F.col("s.section_no")).alias("section_no"), "s.heading", "s.level", "s.content")


def blocks(content: Column) -> Column:
    """Array of (type, content, start_pos): stripped text and [code] blocks in order, empty ones left out; without any, the raw content as one text."""
    kind, mark = "array<struct<type:string,content:string,start_pos:int>>", len("[code][/code]")
    pairs = F.zip_with(F.split(content, CODE, -1), F.regexp_extract_all(content, F.lit(CODE), F.lit(1)), lambda t, c: F.struct(t.alias("t"), c.alias("c")))

    def both(p: Column, at: Column) -> Column:
        found = F.array(
            F.struct(F.lit("text").alias("type"), T.strip(p["t"]).alias("content"), at.alias("start_pos")),
            F.struct(F.lit("code").alias("type"), T.strip(F.coalesce(p["c"], F.lit(""))).alias("content"), (at + F.length(p["t"])).alias("start_pos")),
        )
        return F.filter(found, lambda b: b["content"] != "").cast(kind)

    def placed(ps: Column) -> Column:
        lengths = F.transform(ps, lambda p: F.length(p["t"]) + F.coalesce(F.length(p["c"]) + mark, F.lit(0)))
        return F.flatten(F.zip_with(ps, T.offsets(lengths), both))

    whole = F.array(F.struct(F.lit("text").alias("type"), content.alias("content"), F.lit(0).alias("start_pos"))).cast(kind)
    return T.let(T.let(pairs, placed), lambda found: F.when(F.size(found) > 0, found).otherwise(whole))


_PACKED = "array<struct<content:string,chunk_type:string,start_index:int,end_index:int>>"


def pack(section: Column, sizes: ChunkSizes) -> Column:
    """Array of (content, chunk_type, start_index, end_index): a section's blocks in chunks.

    Headings of levels 1 to 3 begin each chunk.  Size tests leave out separators and
    fences, one block is never split, and chunks below the least size are dropped, though their
    length still moves the offset, which starts at 0 in each section.
    """
    head = F.when(section["heading"].isNotNull() & (section["heading"] != "") & (section["level"] <= 3), F.array(F.concat(T.markdown_mark(section["level"]), F.lit(" "), section["heading"], F.lit("\n")))).otherwise(F.array().cast("array<string>"))
    parts = "array<string>"

    def size(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0), lambda s, x: s + F.length(x))

    def out(acc: Column, joined: Column) -> Column:
        chunk = F.struct(joined.alias("content"), F.when(acc["code"], "code").otherwise("text").alias("chunk_type"), acc["start"].alias("start_index"), (acc["start"] + F.length(joined)).alias("end_index"))
        return F.when(F.length(joined) >= sizes.least, F.concat(acc["out"], F.array(chunk))).otherwise(acc["out"])

    def add(acc: Column, block: Column) -> Column:
        current = F.when(F.size(acc["parts"]) == 0, head).otherwise(acc["parts"])
        over = (F.size(current) > 0) & (size(current) + F.length(block["content"]) > sizes.most)
        joined = T.strip(F.array_join(current, "\n\n"))
        piece = F.when(block["type"] == "code", F.concat(F.lit("```\n"), block["content"], F.lit("\n```"))).otherwise(block["content"])
        return F.struct(
            F.concat(F.when(over, head).otherwise(current), F.array(piece)).cast(parts).alias("parts"),
            (F.when(over, False).otherwise(acc["code"]) | (block["type"] == "code")).alias("code"),
            F.when(over, acc["start"] + F.length(joined)).otherwise(acc["start"]).alias("start"),
            F.when(over, out(acc, joined)).otherwise(acc["out"]).cast(_PACKED).alias("out"),
        )

    zero = F.struct(F.array().cast(parts).alias("parts"), F.lit(False).alias("code"), F.lit(0).alias("start"), F.array().cast(_PACKED).alias("out"))
    return F.aggregate(blocks(section["content"]), zero, add, lambda acc: F.when(F.size(acc["parts"]) > 0, out(acc, T.strip(F.array_join(acc["parts"], "\n\n")))).otherwise(acc["out"]).cast(_PACKED))


CHUNK = "struct<content:string,chunk_type:string,heading:string,start_index:int,end_index:int>"


def chunks(text: Column, sizes: ChunkSizes = ChunkSizes()) -> Column:
    """Array of chunks of a markdown text; a blank or null text has none.

    If nothing survives the least size but the stripped text has it, the text is one chunk, unstripped and without offsets.
    """
    per_section = F.transform(
        F.filter(sections(text), lambda s: s["content"] != ""),
        lambda s: F.transform(pack(s, sizes), lambda c: F.struct(c["content"].alias("content"), c["chunk_type"].alias("chunk_type"), s["heading"].alias("heading"), c["start_index"].alias("start_index"), c["end_index"].alias("end_index"))),
    )
    kind = f"array<{CHUNK}>"

    def whole(stripped: Column) -> Column:
        has_code = F.exists(blocks(text), lambda b: b["type"] == "code")
        one = F.array(F.struct(text.alias("content"), F.when(has_code, "code").otherwise("text").alias("chunk_type"), F.lit(None).cast("string").alias("heading"), F.lit(None).cast("int").alias("start_index"), F.lit(None).cast("int").alias("end_index"))).cast(kind)
        return F.when(F.length(stripped) >= sizes.least, one).otherwise(F.array().cast(kind))

    found = T.let(F.flatten(per_section).cast(kind), lambda packed: F.when(F.size(packed) > 0, packed).otherwise(T.let(T.strip(text), whole)))
    return F.when(text.isNull(), F.array().cast(kind)).otherwise(found)


def chunk_id(source_id: Column, start_index: Column) -> Column:
    return F.concat_ws("_", F.coalesce(source_id, F.lit("unknown")), F.coalesce(start_index, F.lit(0)).cast("string"))


def chunk_documents(docs: DataFrame, content: str = "content", source_id: str | None = "source_id", sizes: ChunkSizes = ChunkSizes()) -> DataFrame:
    """A row a chunk, with the document's other columns: chunk_no, content, chunk_type, heading, start_index, end_index, chunk_id."""
    others = [c for c in docs.columns if c != content]
    flat = docs.select(*others, F.posexplode(chunks(F.col(content), sizes)).alias("chunk_no", "chunk")).select(*others, "chunk_no", "chunk.*")
    return flat.withColumn("chunk_id", chunk_id(F.col(source_id) if source_id else F.lit(None).cast("string"), F.col("start_index")))


def merge_small(items: Column, most: int) -> Column:
    """Array of chunks with neighbouring text chunks joined while their lengths sum to at most `most`; the first one's heading and start stay."""
    kind = f"array<{CHUNK}>"

    def add(acc: Column, chunk: Column) -> Column:
        last = acc["last"]
        fits = F.coalesce((last["chunk_type"] == "text") & (chunk["chunk_type"] == "text") & (F.length(last["content"]) + F.length(chunk["content"]) <= most), F.lit(False))
        joined = F.struct(F.concat(last["content"], F.lit("\n\n"), chunk["content"]).alias("content"), F.lit("text").alias("chunk_type"), last["heading"].alias("heading"), last["start_index"].alias("start_index"), chunk["end_index"].alias("end_index"))
        done = F.when(fits | last.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(last)))
        return F.struct(done.cast(kind).alias("done"), F.when(fits, joined.cast(CHUNK)).otherwise(chunk.cast(CHUNK)).alias("last"))

    zero = F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast(CHUNK).alias("last"))
    return F.aggregate(items, zero, add, lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))).cast(kind))


def is_valid(content: Column, chunk_type: Column, sizes: ChunkSizes) -> Column:
    """Code and tables need only fit; other chunks need the least size too."""
    size = F.length(content)
    return (size <= sizes.most) & (chunk_type.isin("code", "table") | (size >= sizes.least))


def estimate(text: Column, sizes: ChunkSizes) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / ((sizes.least + sizes.most) // 2))).cast("long")


def chunk_stats(rows: DataFrame) -> DataFrame:
    """One row of counts and sizes, all 0 without chunks."""
    n = F.length("content")
    return rows.agg(
        F.count("*").alias("total_chunks"),
        F.count_if(F.col("chunk_type") == "text").alias("text_chunks"),
        F.count_if(F.col("chunk_type") == "code").alias("code_chunks"),
        F.coalesce(F.floor(F.try_divide(F.sum(n), F.count("*"))), F.lit(0)).cast("long").alias("avg_chunk_size"),
        F.coalesce(F.min(n), F.lit(0)).cast("long").alias("min_chunk_size"),
        F.coalesce(F.max(n), F.lit(0)).cast("long").alias("max_chunk_size"),
    )


def samples(rows: DataFrame, order: list[str], n: int = 3) -> DataFrame:
    """The first n chunks in `order` for display."""
    top = rows.orderBy(*order).limit(n)
    preview = F.concat(F.replace(F.substring("content", 1, 150), F.lit("\n"), F.lit(" ")), F.lit("..."))
    return top.select(*order, F.upper("chunk_type").alias("type"), F.length("content").cast("long").alias("size"), F.coalesce("heading", F.lit("None")).alias("heading"), preview.alias("preview"))


def document_stats(docs: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    n = F.length(content)
    return docs.agg(
        F.count("*").alias("total_documents"),
        F.count_if(F.col(path).endswith(".md")).alias("markdown_documents"),
        F.count_if(F.col(path).endswith(".tsx")).alias("tsx_documents"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_characters"),
        F.coalesce(F.floor(F.try_divide(F.sum(n), F.count("*"))), F.lit(0)).cast("long").alias("average_length"),
    )
