"""Vectors by content: a table keyed by a text's hash and the model that encoded it, so that no text is encoded twice.

The table only grows: a refresh finds the hashes that are missing by an anti-join, encodes each such text once and appends the vectors, in a
folder for each model and setting that changes vectors.  Two refreshes at a time may both add a
text; their vectors are equal, and a read takes one of them.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators.deltas import DeltaCollection
from loomwright.operators.embed import embed
from loomwright.operators.index import prepare
from loomwright.schemas import EmbeddingSettings

SCHEMA = "content_hash string, embedding array<float>"


def model_key(settings: EmbeddingSettings) -> str:
    """A name for what decides a text's vector; batch sizes do not."""
    told = {"model": settings.model_name, "dimensions": settings.dimensions, "normalize": settings.normalize, "max_tokens": settings.max_tokens}
    return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()[:32]


def content_hash(text: Column) -> Column:
    """The hash of a text; null where it has no words, since blank texts have the zero vector whatever the model."""
    return F.when(T.filled(text), F.sha2(text, 256))


class VectorStore:
    """The store in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, settings: EmbeddingSettings = EmbeddingSettings()):
        self.spark, self.settings = spark, settings
        self.path = f"{path.rstrip('/')}/vectors/model={model_key(settings)}"

    def _exists(self, path: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def read(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path) if self._exists(self.path) else self.spark.createDataFrame([], SCHEMA)

    def add_missing(self, rows: DataFrame, text: str = "content") -> int:
        """Encode the texts that the store lacks, each once, and append them; returns how many vectors it has more."""
        hashed = rows.select(content_hash(F.col(text)).alias("content_hash"), F.col(text).alias("text")).where("content_hash IS NOT NULL")
        stored = self.read()
        before = stored.count()
        missing = hashed.join(stored.select("content_hash"), "content_hash", "left_anti").groupBy("content_hash").agg(F.min("text").alias("text"))
        # The rows of one hash are equal, so their smallest text is any of them, and is added up before the shuffle.
        embed(missing, "text", "embedding", self.settings).select("content_hash", "embedding").write.mode("append").parquet(self.path)
        return self.read().count() - before

    def with_vectors(self, rows: DataFrame, text: str = "content", out: str = "embedding") -> DataFrame:
        """rows with their texts' vectors from the store; blank and null texts have the zero vector, and texts that it lacks a null."""
        key = "stored_hash"
        while key in rows.columns:
            key += "_"
        one = self.read().groupBy(F.col("content_hash").alias(key)).agg(F.any_value("embedding").alias(f"{key}v"))
        zero = F.array_repeat(F.lit(0.0).cast("float"), self.settings.dimensions)
        joined = rows.join(one, content_hash(F.col(text)) == F.col(key), "left")
        return joined.withColumn(out, F.when(F.coalesce(T.filled(F.col(text)), F.lit(False)), F.col(f"{key}v")).otherwise(zero)).drop(key, f"{key}v")

    def embed(self, rows: DataFrame, text: str = "content", out: str = "embedding") -> DataFrame:
        """As `embed.embed`, by way of the store."""
        self.add_missing(rows, text)
        return self.with_vectors(rows, text, out)

    def forget(self, used: DataFrame, text: str = "content") -> int:
        """Keep only the vectors of these texts; returns how many are left.  No refresh may run meanwhile."""
        kept = self.read().join(used.select(content_hash(F.col(text)).alias("content_hash")).distinct(), "content_hash", "left_semi")
        fresh, fs_path = f"{self.path}.new", self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        kept.dropDuplicates(["content_hash"]).write.mode("overwrite").parquet(fresh)
        fs = fs_path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(fs_path(self.path), True)
        fs.rename(fs_path(fresh), fs_path(self.path))
        return self.read().count()


def refresh(collection: DeltaCollection, store: VectorStore, chunks: DataFrame, content: str = "content", meta: str = "metadata", force: bool = False) -> dict[str, int]:
    """Bring a collection to these chunks: what is new is embedded and written, what they lack is deleted, all else stays where it is.

    Returns how many chunks were handed in, added, deleted, and texts encoded.  Equal chunks are stored once.  `force`, or another model than
    the collection's rows were encoded by, replaces all rows, whose vectors still come from the store where it has them.
    """
    spark, key = collection.spark, model_key(store.settings)
    staged = f"{collection.root}/STAGED.chunks"
    shaped = prepare(chunks.withColumn("no_vector_yet", F.lit(None).cast("array<float>")), content, "no_vector_yet", meta)
    shaped.write.mode("overwrite").parquet(staged)
    try:
        rows = spark.read.schema(shaped.schema).parquet(staged)
        handed = rows.count()
        if force or collection.model() not in (None, key):
            encoded = store.add_missing(rows)
            gone = collection.read().count()
            collection.replace(store.with_vectors(rows.drop("embedding")).select(*rows.columns))
            collection.set_model(key)
            return {"chunks": handed, "added": collection.read().count(), "deleted": gone, "encoded": encoded}
        stored = collection.read().select("id")
        new = rows.join(stored, "id", "left_anti").dropDuplicates(["id"])
        gone = stored.join(rows.select("id"), "id", "left_anti")
        n_new, n_gone = new.count(), gone.count()
        encoded = store.add_missing(new) if n_new else 0
        if n_gone:
            collection.delete(gone)
        if n_new:
            collection.write(store.with_vectors(new.drop("embedding")).select(*rows.columns))
        if collection.model() is None:
            collection.set_model(key)
        return {"chunks": handed, "added": n_new, "deleted": n_gone, "encoded": encoded}
    finally:
        fs, at = collection._fs(staged)
        fs.delete(at, True)
