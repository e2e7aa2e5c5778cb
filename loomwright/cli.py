"""Command line: index a folder of documentation and ask it.

    python -m loomwright.cli index DOCS INDEX [--components DIR] [--force] [--collection NAME]
    python -m loomwright.cli ask INDEX "question" [--top-k N] [--domain D] [--no-answer] [--no-sources]
    python -m loomwright.cli stats INDEX
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import deltas, embed, embed_store, markdown, rag, retrieve
from loomwright.schemas import EmbeddingSettings, RetrievalSettings
from loomwright.session import ship
from loomwright.sources import files


def build(spark: SparkSession, docs: str, path: str, components: str | None = None, collection: str = "docs", sizes: markdown.ChunkSizes = markdown.ChunkSizes(), settings: EmbeddingSettings = EmbeddingSettings(), force: bool = False) -> dict[str, int]:
    """Read and chunk a folder and bring the index to it: only new chunks are embedded and written, those that are gone are deleted.

    The old rows serve until then.  Returns how many chunks were handed in, added, deleted and encoded; `force` writes all rows anew.
    """
    found = files.document_batch(spark, docs, components).withColumn("source", F.element_at(F.split("path", "/"), -1))
    chunks = markdown.chunk_documents(found, source_id="source", sizes=sizes)
    told = chunks.withColumn("metadata", files.chunk_metadata(F.col("metadata"), F.when(F.col("chunk_type") == "code", "code").otherwise("text"), F.col("heading"), F.col("source")))
    own = deltas.DeltaCollection(spark, path, collection)
    return embed_store.refresh(own, embed_store.VectorStore(spark, path, settings), told, force=force)


def ask(spark: SparkSession, path: str, question: str, top_k: int = 5, domain: str | None = None, collection: str = "docs", answer: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """(hits, answer) of one question; raises ValueError for a refused request or an empty collection."""
    asked = spark.createDataFrame([(0, question)], "query_id long, question string")
    refused = asked.select(rag.request_error(F.col("question"), F.lit(top_k))).first()[0]
    if refused:
        raise ValueError(refused)
    own = deltas.DeltaCollection(spark, path, collection)
    if not own.stats()["has_documents"]:
        raise ValueError("the collection is empty")
    vectors = embed.embed(asked, "question", "query_embedding")
    hits = retrieve.retrieve(own.read(), vectors, RetrievalSettings(top_k=top_k, filters={"domain": domain} if domain else {}))
    return hits, rag.generate(rag.prompts(hits, asked)) if answer else None


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomwright")
    sub = parser.add_subparsers(dest="what", required=True)
    one = sub.add_parser("index")
    one.add_argument("docs")
    one.add_argument("path")
    one.add_argument("--components")
    one.add_argument("--force", action="store_true")
    two = sub.add_parser("ask")
    two.add_argument("path")
    two.add_argument("question")
    two.add_argument("--top-k", type=int, default=5)
    two.add_argument("--domain")
    two.add_argument("--no-answer", action="store_true")
    two.add_argument("--no-sources", action="store_true")
    three = sub.add_parser("stats")
    three.add_argument("path")
    for p in (one, two, three):
        p.add_argument("--collection", default="docs")
    got = parser.parse_args(args)
    spark = ship(spark or SparkSession.builder.appName("loomwright").getOrCreate())
    try:
        if got.what == "index":
            told = build(spark, got.docs, got.path, got.components, got.collection, force=got.force)
            print("{chunks} chunks, {added} added, {deleted} deleted, {encoded} encoded".format(**told))
        elif got.what == "stats":
            print(deltas.DeltaCollection(spark, got.path, got.collection).stats())
        else:
            hits, reply = ask(spark, got.path, got.question, got.top_k, got.domain, got.collection, not got.no_answer)
            if reply is not None:
                print(reply.first().answer)
            if not got.no_sources:
                for r in rag.sources(hits).orderBy("rank").collect():
                    print(f"{r['rank']}. {r.source} > {r.heading} ({r.score}) {r.url}")
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
