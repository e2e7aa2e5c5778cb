"""Reading documentation and code trees, and writing pages as markdown files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.functions.udf import arrow_function
from loomwright.schemas import DOCUMENTS, META
from loomwright.sources import walk
from loomwright.sources.stores import write_files

#: Languages of the code-tree source by extension.
TREE_EXTENSIONS = {
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python",
    ".java": "java", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".hpp": "cpp", ".cc": "cpp", ".hh": "cpp", ".cs": "csharp",
}

#: ASCII characters that are quoted in the path of a URI, the quoting sign first.
_UNSAFE = '% "<>\\^`{|}?#[]'


@arrow_function(META, once=True)
def yaml_map(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """YAML mappings with values as text; anything else is null."""
    import yaml

    def one(text: str | None):
        try:
            got = yaml.safe_load(text) if text is not None else None
        except yaml.YAMLError:
            return None
        return {str(k): str(v) for k, v in got.items() if v is not None} if isinstance(got, dict) else None

    for series in texts:
        yield series.map(one)


@arrow_function("string")
def yaml_text(metas: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Maps as YAML, sorted by key; a null map is an empty one."""
    import yaml

    for series in metas:
        yield series.map(lambda m: yaml.safe_dump(dict(m) if m is not None else {}, allow_unicode=True, sort_keys=True))


def parse_frontmatter(files: DataFrame, value: str = "value") -> DataFrame:
    """files with `metadata` and `content`; rows without leading `---`, a second one, or a YAML mapping between are dropped.

    The block ends at the next `---` wherever it stands, even inside a value.
    """
    parts = F.split(F.col(value), "---", 3)
    cut = files.where(F.col(value).startswith("---") & (F.size(parts) >= 3))
    others = [c for c in files.columns if c != value]
    return cut.select(*others, yaml_map(parts[1]).alias("metadata"), T.strip(parts[2]).alias("content")).where(F.col("metadata").isNotNull())


def markdown_directory(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, metadata, content) of the .md files of a folder; a missing folder or file has none.

    Tasks list the folder and read files many at a time, however many there are; one that they cannot walk by name is listed by Spark on the driver.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], DOCUMENTS)
    if walk.reached(path):
        hidden = F.col("source_id").rlike(r"(^|/)(\.|_(?![^/]*=))")  # as Spark's own readers leave out
        listed = walk.walk(spark, path, recursive).where(F.col("source_id").endswith(".md") & ~hidden)
        files = walk.contents(listed, path).select(_uri(_qualified(spark, path), F.col("source_id")).alias("path"), F.col("content").cast("string").alias("value"))
    else:
        found = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True)
        files = found.select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_frontmatter(files)


def tsx_directory(spark: SparkSession, path: str, domain: str = "components", framework: str = "React") -> DataFrame:
    """(path, metadata, content) of .tsx files with made-up metadata named after the file, and the given domain and framework."""
    if walk.reached(path):
        listed = walk.walk(spark, path, recursive=False).where(F.col("source_id").endswith(".tsx"))
        base = _qualified(spark, path).replace("file:/", "file:///", 1)
        files = walk.contents(listed, path).select(F.concat(F.lit(base), "source_id").alias("path"), F.col("content").cast("string").alias("content"))
    else:
        files = spark.read.option("pathGlobFilter", "*.tsx").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    stem = F.regexp_extract("path", r"([^/]+)\.tsx$", 1)
    said = {"title": stem, "component": stem, "category": F.lit("Implementation"), "framework": F.lit(framework), "file_type": F.lit("tsx"), "domain": F.lit(domain)}
    return files.select("path", F.create_map(*(x for k, v in said.items() for x in (F.lit(k), v))).alias("metadata"), "content")


def document_batch(spark: SparkSession, docs: str, components: str | None = None, domain: str = "components") -> DataFrame:
    """The markdown files of one folder and the components of another."""
    found = markdown_directory(spark, docs)
    return found.unionByName(tsx_directory(spark, components, domain)) if components else found


def legacy_type(chunk_type: Column) -> Column:
    """The chunk type as document chunks name it: code chunks are `mixed`, all others `text`."""
    return F.when(chunk_type == "code", "mixed").otherwise("text")


def chunk_metadata(metadata: Column, chunk_type: Column, heading: Column, source: Column | None = None) -> Column:
    """Metadata of a chunk: the document's, then type and heading and the file's name; nulls are left out."""
    more = [F.lit("chunk_type"), chunk_type, F.lit("heading"), heading] + ([F.lit("source"), source] if source is not None else [])
    extra = F.map_filter(F.create_map(*more), lambda k, v: v.isNotNull())
    base = F.map_filter(F.coalesce(metadata, F.create_map().cast(META)), lambda k, v: v.isNotNull() & ~F.map_contains_key(extra, k))
    return F.map_concat(base, extra)


@arrow_function("string")
def _latin(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in raw:
        yield series.map(lambda b: None if b is None else bytes(b).decode("latin-1"))


def _qualified(spark: SparkSession, root: str) -> str:
    """The folder as Spark names it, with a slash at its end."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"


def _uri(base: str, name: Column) -> Column:
    """A file below a folder as `_metadata.file_path` names it: the characters that a URI's path may not have are quoted."""
    whole = F.concat(F.lit(base), name)
    for c in _UNSAFE:
        whole = F.replace(whole, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return whole


def tree_listing(spark: SparkSession, root: str, languages: list[str] | None = None, exclude: list[str] | None = None, since: str | None = None) -> DataFrame:
    """(source_id, path, language, extension, size, modified) of the files that `code_tree` reads, none of which is opened.

    Tasks list the folders.  A root that they cannot walk by name is listed by Spark on the driver, with `content` beside.
    """
    base = _qualified(spark, root)
    if walk.reached(root):
        files = walk.walk(spark, root).withColumn("path", F.concat(F.lit(base), "source_id"))
    else:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        found = (reader.option("modifiedAfter", since) if since else reader).load(root)
        name = F.when(F.col("path").startswith(base), F.substr("path", F.lit(len(base) + 1))).otherwise(F.col("path"))
        files = found.select(name.alias("source_id"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "path", "content")
    wanted = {e: lang for e, lang in TREE_EXTENSIONS.items() if not languages or lang in languages}
    extension = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    kept = files.where(extension.isin(list(wanted)) & (F.col("size") > 0))
    for glob in exclude or []:
        kept = kept.where(~F.col("path").rlike(T.path_pattern(glob)))
    if since:
        kept = kept.where(F.col("modified") > F.lit(since).cast("timestamp"))
    language = F.try_element_at(F.create_map(*(x for e, lang in wanted.items() for x in (F.lit(e), F.lit(lang)))), extension)
    return kept.select("source_id", "path", language.alias("language"), extension.alias("extension"), "size", "modified", *(c for c in files.columns if c == "content"))


def code_tree(spark: SparkSession, root: str, languages: list[str] | None = None, exclude: list[str] | None = None, since: str | None = None, source_id: str | None = None) -> DataFrame:
    """(source_id, path, language, extension, size, modified, content) of a tree's source files, or of the one with that id.

    A file is taken when no exclude glob matches its path from the right and its extension
    belongs to a wanted language.  `since` leaves files that were modified after it, strictly,
    and prunes the listing.  Bytes that are not UTF-8 are read as Latin-1; empty files are left out.
    """
    listed = tree_listing(spark, root, languages, exclude, since)
    listed = listed if source_id is None else listed.where(F.col("source_id") == source_id)
    read = listed if "content" in listed.columns else walk.contents(listed, root)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(_latin("content"))
    shaped = read.select("source_id", "path", "language", "extension", "size", "modified", text.alias("content"))
    return shaped.where(F.col("content") != "")


def file_documents(files: DataFrame) -> DataFrame:
    """Code files as markdown documents with a header and one fence."""
    name = F.element_at(F.split("source_id", "/"), -1)
    body = F.format_string("# %s\n\n**File:** `%s`\n**Language:** %s\n\n```%s\n%s\n```\n", name, F.col("source_id"), F.coalesce("language", F.lit("Unknown")), F.coalesce("language", F.lit("")), F.col("content"))
    return files.select("source_id", F.lit("codebase").alias("source_type"), name.alias("title"), F.coalesce("language", F.lit("unknown")).alias("language"), F.col("modified").alias("last_modified"), "extension", "size", body.alias("content"), F.lit("markdown").alias("format"))


def tree_stats(files: DataFrame, language: str = "language", size: str = "size") -> DataFrame:
    """A row a language with its files, and the totals of all on each."""
    by = files.groupBy(F.col(language).alias("language")).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
    total = by.agg(F.sum("files").alias("total_files"), F.sum("bytes").alias("total_bytes"))
    return by.crossJoin(F.broadcast(total)).withColumn("total_mb", F.round(F.col("total_bytes") / 1048576, 2))  # one row


def write_markdown(pages: DataFrame, folder: str) -> int:
    """Write (url, metadata, markdown) rows as md5(url).md files with frontmatter, from the executors; returns how many.

    `folder` has to be one that all executors share: a local path, or a URI of a store that pyarrow reaches.
    """
    front = yaml_text(F.col("metadata"))
    return write_files(pages.select(F.concat(F.md5("url"), F.lit(".md")).alias("path"), F.concat(F.lit("---\n"), front, F.lit("---\n\n"), F.col("markdown")).alias("content")), folder)
