"""Incremental indexing and change detection with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwright.operators.index import Collection


def stream_files(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; each file is read once."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).parquet(path)


def index_stream(rows: DataFrame, prepare: Callable[[DataFrame], DataFrame], collection: Collection, checkpoint: str, policy: str = "overwrite") -> StreamingQuery:
    """Upsert a stream into a collection, batch by batch, until what is there has been read.

    The checkpoint remembers the files; a batch that is repeated after a failure upserts the same ids, so the index is the same.
    """

    def put(batch: DataFrame, number: int) -> None:
        collection.write(prepare(batch), policy)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_pages(pages: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, url: str = "url", content: str = "html", late: str = "7 days", at: str = "crawled_at") -> StreamingQuery:
    """Pages whose (url, content hash) was not seen within the watermark, handed to `sink`; state older than `late` is dropped."""
    hashed = pages.withColumn("content_hash", F.sha2(content, 256)).withWatermark(at, late)
    fresh = hashed.dropDuplicatesWithinWatermark([url, "content_hash"])
    return fresh.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
