"""A training corpus from `documents`: quality, boilerplate, near-duplicates, benchmark leaks, source mix.

Every stage takes (spark, docs, sf_dir) and returns the documents that it leaves, with
the columns of documents; the last adds how often each is to be repeated.  Stages
read all that their predecessor left.  Empty tables stay empty, null texts fail the quality rules, null ids and
repeated rows are treated as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import decontamination, line_dedup, mixing, near_dedup, quality_rules
from loomwright.llm.common import Scratch, fresh, table
from loomwright.session import ship

#: No SQL states the perplexity bands, the minhash tables or the knapsack; tests compare run() with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's perplexity band.

    Null, empty and blank texts have too few words and go.  A text of any length is measured whole; repeated rows all stay or all go;
    a null language has a band of its own; null ids play no part; an empty table stays empty; other columns pass through.
    """
    ship(spark)
    return quality_rules.filter_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; n_chars follows the text.

    Every row stays: a null text is null, one that loses all its lines is empty.  A null source is a source; repeated rows count as pages
    each and lose the same lines; an empty table stays empty; other columns pass through.
    """
    ship(spark)
    cut = line_dedup.drop_boilerplate(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else cut.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest id.

    Texts without words are in no group and stay.  Equal rows count once; rows of one id with different texts stay together; documents
    without an id stay; an empty table stays empty; other columns pass through.
    """
    ship(spark)
    return near_dedup.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Texts without words hold none and stay, as all do if the benchmark is empty; its null ids and texts have no window.  Repeated rows fare
    alike; null ids play no part; an empty table stays empty; other columns pass through.
    """
    ship(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with `size` in words, their source's `target` and `copies`, in place of columns of these names.

    A text without words has size 0 and is taken only where its source is taken whole.  A null source is one of its own, the last; equal
    rows are interchangeable; an empty table stays empty; other columns pass through.
    """
    ship(spark)
    results = ("size", "target", "copies")
    kept = docs.drop(*results)
    aside = fresh(kept, "source_size_")  # the mix has a source_size of its own
    mixed = mixing.mix(kept.withColumnRenamed("source_size", aside).withColumn("size", mixing.n_words(F.col("text"))))
    return mixed.where("copies > 0").select(*(F.col(aside).alias(c) if c.lower() == "source_size" else c for c in kept.columns), *results)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicates", near_duplicates), ("benchmark decontamination", benchmark_leaks), ("source mix", source_mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again before the next."""
    scratch = Scratch(ship(spark), "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = scratch.keep(docs, f"stage{number}")
    return docs
