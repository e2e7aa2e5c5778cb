"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length.  A source whose target is not
below its size gives every document once and spends the rest on second copies; any other spends
its whole target on first copies.  What is to be spent goes to the lengths in proportion, and the
remainder is fitted by a bounded-knapsack dynamic programme over lengths.  Which
documents of a length are taken is decided by a seeded hash of their ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import Scratch, broadcast_if, fresh

WEIGHTS, SHARE, MOST, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 17
#: The budget that the dynamic programme fits exactly, in words; larger remainders are first brought down by whole documents, longer ones of which it fits in coarser units.
CAPACITY = 1 << 15
#: Seeded hashes are ranked by their top bits first, so that no length is sorted whole in one task.
BUCKET_BITS = 12
#: Lengths of all sources whose cuts are broadcast, at about 60 bytes each; more are joined.
BROADCAST_LENGTHS = 1 << 18


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size), a row each.

    Sources in code-point order, null last, take the weights in turn.  Targets are
    level * weight but at most `most` times the size, the level being such that they
    sum to `share` of all sizes.  Ranks come from range partitions, so no task orders all sources.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, "targets")
    ranged = scratch.keep(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranged")
    before, at = {}, 0
    for row in ranged.groupBy("part").count().orderBy("part").collect():  # one row a partition
        before[row["part"]], at = at, at + row["count"]
    offset = F.coalesce(*(F.when(F.col("part") == k, v) for k, v in before.items()), F.lit(0)) if before else F.lit(0)
    rank = offset + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    ranked = scratch.keep(ranged.select("source", "source_size", weight.alias("weight")), "ranked")
    cap = most * F.col("source_size")
    total, level = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first(), 0.0
    level = share * total[0] / total[1] if total[1] else 0.0
    while True:  # a level only rises, and each round caps at least one source more
        above = F.lit(level) * F.col("weight") > cap
        got = ranked.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        new = (share * total[0] - got[0]) / got[1] if got[1] else level
        if new <= level * (1 + 1e-12):
            break
        level = new
    return ranked.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap))


def _programme(sizes: np.ndarray, spare: np.ndarray, budget: int) -> np.ndarray:
    """How many of each size to take, at most `spare`, so that their sum is the largest up to `budget`."""
    take = np.zeros(len(sizes), np.int64)
    mask, sums, chunks = (1 << (budget + 1)) - 1, 1, []
    history = []
    for i in np.flatnonzero((spare > 0) & (sizes <= budget)):
        some, step = int(min(spare[i], budget // sizes[i])), 1
        while some:  # binary parts of a bounded count
            n = min(step, some)
            history.append(sums)
            chunks.append((i, n))
            sums |= (sums << (n * int(sizes[i]))) & mask
            some, step = some - n, step * 2
        if sums >> budget:
            break
    best = sums.bit_length() - 1
    for (i, n), earlier in zip(reversed(chunks), reversed(history)):
        if not (earlier >> best) & 1:
            take[i] += n
            best -= n * int(sizes[i])
    return take


def _fitted(lengths: np.ndarray, counts: np.ndarray, budget: int, aim: int, capacity: int) -> np.ndarray:
    """Takes in proportion to `aim` words, and what is then left of the budget fitted by the programme."""
    usable = lengths > 0
    total = int((lengths * counts).sum())
    take = np.zeros(len(lengths), np.int64)
    if total:
        take[usable] = np.minimum(counts, np.floor(counts * min(aim / total, 1.0)).astype(np.int64))[usable]
    left = budget - int((take * lengths).sum())
    if left > capacity:  # lengths above the capacity are fitted by the programme too, in units that make it small enough
        unit = -(-left // capacity)
        take += _programme(-(-lengths // unit), np.where(lengths > capacity, counts - take, 0), left // unit)
        left = budget - int((take * lengths).sum())
    for i in np.flatnonzero(usable)[::-1]:
        if left <= capacity:
            break
        spare, size = int(counts[i] - take[i]), int(lengths[i])
        n = min(spare, -(-(left - capacity) // size) if size <= capacity else left // size)
        take[i] += n
        left -= n * size
    if 0 < left <= capacity:  # above it, all that could still be taken is longer than what is left
        take += _programme(lengths, np.where(usable, counts - take, 0), left)
    return take


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, capacity: int = CAPACITY) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near `budget` as they can from below.

    Lengths are taken in proportion.  Where the programme cannot spend all that is left, more and more of the proportional takes are
    handed to it, up to all that `capacity` words hold: below that budget the sum is the largest there is.
    """
    order = np.argsort(lengths)
    lengths, counts = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    best, short = np.zeros(len(lengths), np.int64), budget
    for handed in (0, capacity // 64, capacity // 8, capacity):
        take = _fitted(lengths, counts, budget, max(budget - handed, 0), capacity)
        gap = budget - int((take * lengths).sum())
        if gap < short or handed == 0:
            best, short = take, gap
        if not short or handed >= budget or short == budget - int((lengths * counts).sum()):
            break
    out = np.zeros(len(best), np.int64)
    out[order] = best
    return out


def mix(docs: DataFrame, source: str = "source", size: str = "size", doc_id: str = "doc_id", seed: int = SEED, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """docs, which have a word count in `size`, with `source_size`, `target` and `copies` (0, 1 or 2 at the default `most`).

    Sources may be null and form one of their own; ids may be null or repeat, and equal
    rows are interchangeable.  Sizes of 0 are never taken twice.  Columns of the
    three result names are replaced; an empty table gives an empty one.  A source's plan is made from its distinct lengths alone, of
    which there are no more than its longest document has words, about 20 bytes each.
    """
    docs = docs.drop("source_size", "target", "copies")
    scratch = Scratch(docs.sparkSession, "mix")
    key = fresh(docs, "mix_hash")
    order = F.xxhash64(F.col(doc_id), F.lit(seed))
    lean = scratch.keep(docs.select(F.col(source).alias("source"), F.col(size).alias("size"), order.alias("h")), "lean")
    bucket = F.shiftright("h", 64 - BUCKET_BITS).cast("int")
    counts = scratch.keep(lean.groupBy("source", "size", bucket.alias("bucket")).agg(F.count("*").alias("n")), "counts")
    by_source = targets(counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("source_size")), weights, share, most)
    by_length = counts.groupBy(F.col("source").alias("s"), "size").agg(F.sum("n").alias("n"))
    histogram = by_length.join(by_source, F.col("s").eqNullSafe(F.col("source"))).select("source", "size", "n", "source_size", "target")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        whole, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        base = int(target // whole) if whole else 1
        extra = fit_lengths(rows["size"].to_numpy(), rows["n"].to_numpy(), int(round(target)) - base * whole) if base < most else 0
        return rows[["source", "size", "source_size", "target"]].assign(base=base, extra=extra)

    kind = dict(docs.dtypes)[source]
    plan = scratch.keep(histogram.groupBy("source").applyInPandas(choose, f"source {kind}, size long, source_size long, target double, base int, extra long"), "plan")
    # Of each length, the extra copies go to the smallest hashes: find the last one's, looking only into the bucket that has it.
    named = plan.where("extra > 0").select(F.col("source").alias("p_source"), F.col("size").alias("p_size"), "extra")
    upto = F.sum("n").over(Window.partitionBy("source", "size").orderBy("bucket"))
    edge = counts.withColumn("upto", upto).join(named, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))).where("upto >= extra and upto - n < extra")
    edge = edge.select(F.col("source").alias("e_source"), F.col("size").alias("e_size"), F.col("bucket").alias("e_bucket"), (F.col("extra") - F.col("upto") + F.col("n")).alias("need"))
    inside = lean.join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("size") == F.col("e_size")) & (bucket == F.col("e_bucket"))).select("source", "size", "h", "need")
    values = inside.groupBy("source", "size", "need", "h").agg(F.count("*").alias("times"))  # equal ids have equal hashes
    ranked = values.withColumn("upto", F.sum("times").over(Window.partitionBy("source", "size").orderBy("h")))
    last = ranked.where("upto >= need and upto - times < need").select(F.col("source").alias("l_source"), F.col("size").alias("l_size"), F.col("h").alias("last"), (F.col("need") - F.col("upto") + F.col("times")).alias("take"), "times")
    cuts = plan.join(last, F.col("source").eqNullSafe(F.col("l_source")) & (F.col("size") == F.col("l_size")), "left")
    c = {x: fresh(docs, f"mix_{x}") for x in ("source", "size", "base", "last", "take", "times")}
    cuts = scratch.keep(cuts.select("source_size", "target", *(F.col(x).alias(c[x]) for x in c)), "cuts")
    keyed = docs.withColumn(key, order)
    joined = keyed.join(broadcast_if(cuts, BROADCAST_LENGTHS), F.col(source).eqNullSafe(F.col(c["source"])) & (F.col(size) == F.col(c["size"])))
    more = F.when(F.col(key) < F.col(c["last"]), 1).when((F.col(key) == F.col(c["last"])) & (F.col(c["take"]) == F.col(c["times"])), 1).otherwise(0)
    out = joined.withColumn("copies", F.col(c["base"]) + more)
    torn = (F.col(key) == F.col(c["last"])) & (F.col(c["take"]) < F.col(c["times"]))
    if cuts.where(F.col(c["take"]) < F.col(c["times"])).limit(1).count():  # only some rows of one id are taken
        rank = F.row_number().over(Window.partitionBy(c["source"], c["size"]).orderBy(key))
        some = out.where(torn).withColumn("copies", F.col(c["base"]) + F.when(rank <= F.col(c["take"]), 1).otherwise(0))
        out = out.where(~F.coalesce(torn, F.lit(False))).unionByName(some)
    return out.select(*docs.columns, "source_size", "target", "copies")
