"""Vectors by content, and refreshes that encode what is new only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import deltas, embed, embed_store
from loomwright.schemas import EmbeddingSettings

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def counted(spark):
    """A provider that counts what it encodes, wherever it runs."""
    seen = spark.sparkContext.accumulator(0)

    class Counting(embed.HashedWords):
        def encode(self, texts):
            seen.add(len(texts))
            return super().encode(texts)

    embed.register("counting", Counting)
    yield seen
    del embed.PROVIDERS["counting"]


def _vectors(df, key="content"):
    return {r[key]: tuple(r.embedding) for r in df.collect()}


def test_a_second_refresh_encodes_changes_only(spark, tmp_path, counted):
    settings = EmbeddingSettings(model_name="counting", dimensions=16)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text").alias("content"), F.create_map(F.lit("domain"), "lang").alias("metadata"))
    own, store = deltas.DeltaCollection(spark, f"file://{tmp_path}/i", "c", buckets=4), embed_store.VectorStore(spark, f"file://{tmp_path}/i", settings)
    first = embed_store.refresh(own, store, docs)
    distinct = docs.select("content").distinct().count()
    assert first["encoded"] == counted.value == distinct and first["deleted"] == 0
    again = embed_store.refresh(own, store, docs)
    assert again == {"chunks": docs.count(), "added": 0, "deleted": 0, "encoded": 0} and counted.value == distinct
    changed = docs.withColumn("content", F.when(F.col("doc_id") % 100 == 0, F.concat("content", F.lit(" more"))).otherwise(F.col("content")))
    told = embed_store.refresh(own, store, changed)
    new = changed.where("doc_id % 100 = 0").select("content").distinct().count()
    assert told["encoded"] == told["added"] == new == counted.value - distinct
    full = deltas.DeltaCollection(spark, f"file://{tmp_path}/j", "c")
    embed_store.refresh(full, embed_store.VectorStore(spark, f"file://{tmp_path}/j", settings), changed)
    assert _vectors(own.read(), "id") == _vectors(full.read(), "id")
    # Another model: all rows again, in a table of their own.
    other = embed_store.VectorStore(spark, f"file://{tmp_path}/i", EmbeddingSettings(model_name="counting", dimensions=8))
    told = embed_store.refresh(own, other, changed)
    assert told["added"] == own.read().count() and {len(v) for v in _vectors(own.read(), "id").values()} == {8}
    assert embed_store.refresh(own, other, changed)["added"] == 0
    before = counted.value
    assert embed_store.refresh(own, other, changed, force=True)["encoded"] == 0 and counted.value == before


def test_store(spark, tmp_path):
    settings = EmbeddingSettings(dimensions=8)
    store = embed_store.VectorStore(spark, f"file://{tmp_path}", settings)
    rows = spark.createDataFrame([("a b", 1), ("a b", 2), (None, 3), (" ", 4), ("c", 5)], "content string, stored_hash int")
    got = store.embed(rows)
    want = embed.embed(rows, settings=settings)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and store.read().count() == 2
    assert store.add_missing(rows) == 0
    # Two refreshes at a time: a text may be there twice, and counts once.
    store.read().write.mode("append").parquet(store.path)
    assert store.with_vectors(rows).count() == 5
    assert store.forget(rows.where("content = 'c'")) == 1
    lacking = _vectors_or_none(store.with_vectors(rows))
    assert lacking["a b"] is None and np.isclose(np.linalg.norm(lacking["c"]), 1) and lacking[" "] == [0.0] * 8
    assert embed_store.model_key(settings) == embed_store.model_key(EmbeddingSettings(dimensions=8, batch_size=3)) != embed_store.model_key(EmbeddingSettings(dimensions=9))


def _vectors_or_none(df):
    return {r.content: r.embedding for r in df.collect()}
