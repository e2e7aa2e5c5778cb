"""The vector index: versioned Parquet collections with upsert.

A collection is a folder of versions and a pointer file that names the current one.  A write makes
a new version and then replaces the pointer, so readers never see an empty or
half-written index, and a clear is a version without rows.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.schemas import HOT_KEYS, INDEX

POLICIES = ("overwrite", "skip", "fail")


class DuplicateError(ValueError):
    """Raised under the policy `fail` when an id exists already."""


def document_id(content: Column, meta: Column) -> Column:
    """sha256 of the content and the metadata sorted by key: equal documents share an id."""
    entries = F.array_join(F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat_ws("=", e["key"], e["value"])), "\u0001")
    return F.sha2(F.concat_ws("\u0002", content, entries), 256)


def prepare(chunks: DataFrame, content: str = "content", embedding: str = "embedding", meta: str = "metadata") -> DataFrame:
    """Chunks in the index's schema: null metadata goes, hot keys become columns."""
    clean = F.map_filter(F.coalesce(F.col(meta), F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    hot = [F.try_element_at(F.col("meta"), F.lit(k)).alias(k) for k in HOT_KEYS]
    shaped = chunks.select(F.col(content).alias("content"), F.col(embedding).alias("embedding"), clean.alias("meta"))
    return shaped.select(document_id(F.col("content"), F.col("meta")).alias("id"), "content", "embedding", *hot, "meta")


def check_policy(policy: str) -> None:
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {', '.join(POLICIES)}")


def one_a_key(incoming: DataFrame, key: str = "id") -> DataFrame:
    """Of the rows of each key the one with the smallest columns, maps last; an aggregate, which needs no sort of a hot key.

    A row is in the shuffle once, and the result stays dealt by its key.
    """
    kinds = dict(incoming.dtypes)
    maps = [c for c, kind in kinds.items() if kind.startswith("map")]
    plain = [c for c in kinds if c not in maps]
    by_key = incoming.groupBy(F.col(key).alias("_key"))
    if any(kinds[c].count("map<") > 1 or "variant" in kinds[c] for c in maps):  # their entries have no order
        one = by_key.agg(F.min_by(F.struct(*incoming.columns), F.struct(*plain)).alias("_row"))
        own = {c: F.col(f"_row.`{c}`") for c in kinds}
    else:
        one = by_key.agg(F.min(F.struct(*plain, *(F.array_sort(F.map_entries(c)).alias(c) for c in maps))).alias("_row"))
        own = {c: F.map_from_entries(F.col(f"_row.`{c}`")) if c in maps else F.col(f"_row.`{c}`") for c in kinds}
    return one.select(*((F.col("_key") if c == key else own[c]).alias(c) for c in incoming.columns))


def upsert(existing: DataFrame, incoming: DataFrame, policy: str = "overwrite", key: str = "id") -> DataFrame:
    """Rows after writing `incoming`, one a key.

    overwrite: incoming rows win; skip: existing ones do; fail: a shared key raises.  Among
    incoming rows of one key the one with the smallest columns stays, which is an aggregate and needs no sort of a hot key.
    """
    check_policy(policy)
    if policy == "fail" and incoming.join(existing, key, "left_semi").limit(1).count():
        raise DuplicateError(f"some {key} exists already")
    one = one_a_key(incoming, key)
    if policy == "skip":
        return existing.unionByName(one.join(existing, key, "left_anti").select(*existing.columns))
    return existing.join(one, key, "left_anti").select(*existing.columns).unionByName(one)


class Conflict(RuntimeError):
    """Raised when another writer published first."""


class Collection:
    """A named collection under a path that all executors share."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.name, self.root = spark, name, f"{path.rstrip('/')}/collection={name}"

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def version(self) -> str | None:
        fs, at = self._fs(f"{self.root}/CURRENT")
        return self.spark.read.text(f"{self.root}/CURRENT").first()[0] if fs.exists(at) else None

    def read(self) -> DataFrame:
        return self._of(self.version())

    def _of(self, version: str | None) -> DataFrame:
        return self.spark.createDataFrame([], INDEX) if version is None else self.spark.read.schema(INDEX).parquet(f"{self.root}/{version}")

    def _publish(self, rows: DataFrame, base: str | None) -> None:
        """Write a version that follows `base`, point to it, and delete the versions before `base`, which readers may still hold.

        Only one writer can claim to follow a version: the others get a Conflict.
        """
        version = f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{version}")
        self._point(version, base)
        fs, _ = self._fs(self.root)
        for found in fs.listStatus(self._fs(self.root)[1]):
            name = found.getPath().getName()
            if name.startswith(("v-", "AFTER.")) and name.removeprefix("AFTER.") not in (version, base, "None"):
                fs.delete(found.getPath(), True)

    def _point(self, version: str, base: str | None) -> None:
        """Make `version`, a file or folder that is written, the current one if nothing else follows `base`; else delete it and raise Conflict."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, claim = self._fs(f"{self.root}/AFTER.{base}")
        try:
            fs.create(claim, False).close()
        except Py4JJavaError as e:
            fs.delete(self._fs(f"{self.root}/{version}")[1], True)
            if "AlreadyExists" in str(e.java_exception):
                raise Conflict(f"another writer follows {base}") from None
            raise
        if self.version() != base:  # it was followed long ago, and its claim is gone
            for name in (f"AFTER.{base}", version):
                fs.delete(self._fs(f"{self.root}/{name}")[1], True)
            raise Conflict(f"another writer followed {base}")
        at = self._fs(f"{self.root}/CURRENT.{version}")[1]
        self._put(at, version)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(at, self._fs(f"{self.root}/CURRENT")[1], options)

    def _put(self, at, text: str) -> None:
        out = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray(text.encode()))
        out.close()

    def write(self, chunks: DataFrame, policy: str = "overwrite", tries: int = 5) -> int:
        """Upsert prepared rows; returns how many were handed in, not how many are stored.

        The rows are made once, as a staged table that is counted and merged; when another writer was first, they are merged with its version.
        """
        staged = f"{self.root}/STAGED.{uuid.uuid4().hex}"
        chunks.write.parquet(staged)
        try:
            rows = self.spark.read.schema(chunks.schema).parquet(staged)
            for turn in range(tries):
                base = self.version()
                try:
                    self._publish(upsert(self._of(base), rows, policy), base)
                    break
                except Conflict:
                    if turn + 1 == tries:
                        raise
            return rows.count()
        finally:
            fs, at = self._fs(staged)
            fs.delete(at, True)

    def replace(self, chunks: DataFrame) -> int:
        """A new index of these rows alone; readers have the old one until it is whole.  Returns how many were handed in."""
        staged = f"{self.root}/STAGED.{uuid.uuid4().hex}"
        chunks.write.parquet(staged)
        try:
            rows = self.spark.read.schema(chunks.schema).parquet(staged)
            self._publish(upsert(self._of(None), rows), self.version())
            return rows.count()
        finally:
            fs, at = self._fs(staged)
            fs.delete(at, True)

    def release(self) -> None:
        """Give up the claim of a writer that died before it published."""
        fs, at = self._fs(f"{self.root}/AFTER.{self.version()}")
        fs.delete(at, False)

    def drop(self) -> None:
        """Delete the collection and all its versions."""
        fs, at = self._fs(self.root)
        fs.delete(at, True)

    def clear(self) -> None:
        self._publish(self.spark.createDataFrame([], INDEX), self.version())

    def stats(self) -> dict:
        n = self.read().count()
        return {"collection": self.name, "document_count": n, "has_documents": n > 0, "path": self.root}

    def status(self) -> dict:
        """stats, or what went wrong."""
        try:
            return {"status": "ready" if (found := self.stats())["has_documents"] else "empty", **found}
        except Exception as e:  # noqa: BLE001  a status never fails
            return {"status": "error", "collection": self.name, "error": f"{type(e).__name__}: {e}"}
