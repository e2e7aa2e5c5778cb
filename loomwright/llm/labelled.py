"""Bounded, reproducible samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a sample holds at most, shared by the classes as their numbers of documents are.
MOST_BYTES = 44 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int | tuple[int, int], most_bytes: int = MOST_BYTES) -> tuple[DataFrame, dict[int, int]]:
    """(text, y) of at most `per_class` labelled documents of each class (or as many of class 0 and 1), and the number of labels of each class.

    `keep` is a condition on doc_id that a learnable row meets.  The rows with the
    smallest hashes of doc_id are taken, so reruns agree; a document with several
    labels has the largest; null labels and null ids teach nothing, nor do null texts.  Of rows that share an id the one with the
    smallest hash of its text is taken.  Documents that would bring a class's texts above its share of `most_bytes` are
    passed over.  Ids, lengths and texts of a sample are thus bounded; empty tables give an empty one.
    """
    spark = docs.sparkSession
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & keep)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    most = (per_class, per_class) if isinstance(per_class, int) else per_class
    first = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[y]) for y in (0, 1)]
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).withColumn("h", F.xxhash64("text"))
    found = texts.join(F.broadcast(first[0].unionByName(first[1])), "doc_id")
    measured = found.groupBy("doc_id", "y").agg(F.min(F.struct("h", F.octet_length("text").alias("bytes"))).alias("t"))
    left, chosen = [most_bytes * most[y] // max(sum(most), 1) for y in (0, 1)], []
    for r in measured.orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # a row for each of at most sum(most) ids
        if r["t"]["bytes"] <= left[r["y"]]:
            left[r["y"]] -= r["t"]["bytes"]
            chosen.append((r["doc_id"], r["y"], r["t"]["h"]))
    wanted = F.broadcast(spark.createDataFrame(chosen, f"doc_id {dict(docs.dtypes)['doc_id']}, y int, h long"))
    return texts.join(wanted, ["doc_id", "h"]).groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).select("text", "y"), sizes
