"""Connected components of a link table, by rounds of joins; no link or label reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, label) of the nodes of links (a, b): label is the smallest node that is reachable.

    Each round a node takes the smallest label among its neighbours' and then its
    label's label, so long chains shorten by jumps.  Written after each round.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct()
    both = scratch.keep(both, f"{tag}-links")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), f"{tag}-labels0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        jumped = least.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        written = scratch.keep(jumped, f"{tag}-labels{turn}")
        moved = written.where(F.col("old") != F.col("label")).limit(1).count()
        labels = written.select("node", "label")
        scratch.drop(f"{tag}-labels{turn - 1}") if turn > 1 else None
        if not moved:
            return labels
