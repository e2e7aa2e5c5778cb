"""Sources of documents behind one interface."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import code_parse
from loomwright.sources import files


class NotFound(LookupError):
    """Raised for a document that a source does not have."""


class Source(ABC):
    """A source: rows of documents, those of one id, and those changed since a time.  A source is a context manager; entering connects."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def connect(self) -> None:
        """Check that the source is there."""

    def disconnect(self) -> None:
        """Let go of what connect took."""

    def __enter__(self) -> Source:
        self.connect()
        return self

    def __exit__(self, *_) -> None:
        self.disconnect()

    @abstractmethod
    def documents(self, languages: list[str] | None = None, since: str | None = None) -> DataFrame:
        """All documents, lazily; of some languages, or modified after a time."""

    def ids(self, languages: list[str] | None = None, limit: int | None = None) -> DataFrame:
        found = self.documents(languages).select("source_id").orderBy("source_id")
        return found.limit(limit) if limit else found

    def fetch(self, source_id: str) -> DataFrame:
        """The row of one document."""
        found = self.documents().where(F.col("source_id") == source_id)
        if not found.limit(1).count():
            raise NotFound(source_id)
        return found


class CodeTree(Source):
    """A tree of source files."""

    def __init__(self, spark: SparkSession, root: str, exclude: list[str] | None = None):
        super().__init__(spark)
        self.root, self.exclude = root, exclude or []

    def connect(self) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            raise NotFound(self.root)

    def files(self, languages: list[str] | None = None, since: str | None = None) -> DataFrame:
        return files.code_tree(self.spark, self.root, languages, self.exclude, since)

    def documents(self, languages: list[str] | None = None, since: str | None = None) -> DataFrame:
        return files.file_documents(self.files(languages, since))

    def ids(self, languages: list[str] | None = None, limit: int | None = None) -> DataFrame:
        """Ids by the listing alone; no file is opened."""
        found = files.tree_listing(self.spark, self.root, languages, self.exclude).select("source_id").orderBy("source_id")
        return found.limit(limit) if limit else found

    def fetch(self, source_id: str) -> DataFrame:
        found = files.file_documents(files.code_tree(self.spark, self.root, exclude=self.exclude, source_id=source_id))
        if found.isEmpty():
            raise NotFound(source_id)
        return found

    def entities(self, languages: list[str] | None = None) -> DataFrame:
        """The functions and classes of all files as documents; files that do not parse have none."""
        return code_parse.entity_documents(code_parse.entities(self.files(languages), path="source_id"))

    def stats(self) -> DataFrame:
        return files.tree_stats(files.tree_listing(self.spark, self.root, exclude=self.exclude))
