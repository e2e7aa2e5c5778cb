"""Line dedup by site-relative frequency.

A line is boilerplate of its host when the share of the host's pages that contain it exceeds a
ratio.  Lines compare without the spaces, tabs and carriage returns at their
ends; blank lines are never dropped.  Counting uses two 64-bit hashes of a line, added up
before the shuffle, so a line on a third of all pages is one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import Scratch, fresh

#: Share of a host's pages above which a line is boilerplate, and the fewest pages that a boilerplate line is on.
RATIO, LEAST_PAGES = 0.015, 5
#: Boilerplate lines of all hosts that are broadcast, at about 40 bytes each; more are joined.
BROADCAST_LINES = 1 << 18


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(" \t\r"))
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(bare, F.lit(1)).alias("b"))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r")) == ""


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, line, pages, host_pages) of the boilerplate lines, `line` being the pair of hashes."""
    pages = docs.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_pages"))
    each = docs.select(F.col(host).alias("host"), F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: ~_blank(x)), _key))).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    totals = pages.withColumnRenamed("host", "page_host")
    joined = counts.join(totals, F.col("host").eqNullSafe(F.col("page_host"))).drop("page_host")
    return joined.where(F.col("pages") > ratio * F.col("host_pages"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, doc_id: str = "doc_id", n_lines: str | None = None, n_dropped: str | None = None, most: int = BROADCAST_LINES) -> DataFrame:
    """docs with boilerplate lines cut from `text`; with names for them, also the counts of lines and of dropped lines.

    An empty table stays empty.  A null text stays null and has no lines; an empty one has one blank line.  A null
    host is a host of its own.  Repeated rows count as pages each and lose the same lines.  A page
    may lose all its lines and stays, with an empty text.  Up to `most` boilerplate lines are broadcast by
    host and texts are not shuffled; beyond, texts meet their cuts by host and id.  Which lines go depends on
    host and line alone, so rows that share both need not be told apart.
    """
    names = {k: fresh(docs, k) for k in ("cut_host", "cut_id", "cut_lines", "line_key")}
    drops = Scratch(docs.sparkSession, "lines").keep(boilerplate(docs, host, text, ratio, least_pages).select("host", "line"), "drops")
    if drops.limit(most + 1).count() <= most:
        # A host has at most its mean number of lines a page over the ratio; so its list is short.
        by_host = F.broadcast(drops.groupBy(F.col("host").alias(names["cut_host"])).agg(F.collect_set("line").alias(names["cut_lines"])))
        joined = docs.join(by_host, docs[host].eqNullSafe(F.col(names["cut_host"])), "left").withColumn(names["cut_id"], F.lit(None))
    else:
        drops = drops.select(F.col("host").alias(names["cut_host"]), F.col("line").alias(names["line_key"]))
        keyed = docs.select(F.col(host).alias("host"), F.col(doc_id).alias("id"), F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: ~_blank(x)), _key))).alias("line"))
        cuts = keyed.join(drops, F.col("host").eqNullSafe(F.col(names["cut_host"])) & (F.col("line") == F.col(names["line_key"])))
        cuts = cuts.groupBy(F.col("host").alias("cut_by"), F.col("id").alias(names["cut_id"])).agg(F.collect_set("line").alias(names["cut_lines"])).withColumnRenamed("cut_by", names["cut_host"])
        joined = docs.join(cuts, docs[host].eqNullSafe(cuts[names["cut_host"]]) & docs[doc_id].eqNullSafe(cuts[names["cut_id"]]), "left")
    lines = _lines(F.col(text))
    left = F.filter(lines, lambda x: _blank(x) | ~F.array_contains(F.col(names["cut_lines"]), _key(x)))
    has = F.col(names["cut_lines"]).isNotNull() & F.col(text).isNotNull()
    more = {}
    if n_lines:
        more[n_lines] = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
    if n_dropped:
        more[n_dropped] = F.when(has, F.size(lines) - F.size(left)).otherwise(0).cast("long")
    out = joined.withColumns(more) if more else joined
    return out.withColumn(text, F.when(has, F.array_join(left, "\n")).otherwise(F.col(text))).drop(names["cut_host"], names["cut_id"], names["cut_lines"])
