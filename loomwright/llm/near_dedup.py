"""MinHash near-duplicates with tensored banding.

A text's set is its distinct word shingles.  Texts of equal sets, as two 64-bit sums of independent hashes and the size tell, form a
class, and classes are what is compared.  Instead of ROWS * SIDE**2 minhashes for SIDE**2 tables,
two collections of SIDE half keys of ROWS / 2 minhashes each are computed, and
table (i, j) has the key (half i of the first, half j of the second): the number of
minhashes falls from ROWS * SIDE**2 to ROWS * SIDE.  Candidates are verified on
their full sets.

Buckets are never expanded into all pairs.  First every member is verified against its
bucket's smallest class, whose set is dealt to as many tasks as it has members for.  What this leaves under different labels in a
bucket is compared by tasks that hold one bounded block of the bucket's sets and stream through those that ask, which are the ones
outside the bucket's largest label; they return links only.  Buckets of equal members are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import Scratch, broadcast_if, fresh, may_hold
from loomwright.llm.components import components
from loomwright.llm.vectext import NON_SPACE, U64, Words, as_bytes, blocks, fmix, lean, pair_hash

#: Minhashes in a table's key, and half keys in a collection.  A pair of similarity s shares a table
#: with probability (1 - (1 - s**(ROWS/2))**SIDE)**2: 0.9996 at 0.8, 0.00014 at 0.1.
ROWS, SIDE, SEED = 6, 12, 20240607
#: Words of a shingle, and the least similarity of a link, in hundredths.
SHINGLE, LEAST = 5, 80
#: Set elements that a block holds, unless one set is larger.
BLOCK_ELEMENTS = 1 << 19
#: Pairs of one lead that a task verifies, and shared elements that are counted at once.
PAIRS, MATCHES = 1 << 11, 1 << 19
#: Leads with more than PAIRS pairs that are broadcast, at 12 bytes each; more are joined.  Table keys that a task makes on average.
LEADS, KEYED = 1 << 18, 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, row by row; start of each row's).  A text of fewer words has its whole sequence as one shingle."""
    words = Words(data, offsets, NON_SPACE, lower=True)
    h, first = words.hashes(), words.first
    grams = h.copy()
    for k in range(1, min(width, len(h))):
        grams[: len(h) - k] = pair_hash(grams[: len(h) - k], h[k:])
    parts, sizes = [], []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            own = np.unique(grams[a : b - width + 1])
        elif b > a:
            whole = h[a : a + 1]
            for k in range(a + 1, b):
                whole = pair_hash(whole, h[k : k + 1])
            own = fmix(whole + U64(b - a))
        else:
            own = h[:0]
        parts.append(own)
        sizes.append(len(own))
    return (np.concatenate(parts) if parts else h[:0]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def class_ids(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit identity of each row's set as two numbers, each from the size and a sum of hashes of its own."""
    size = np.diff(starts)
    full = np.flatnonzero(size)
    out = []
    for salt in (U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)):
        one = np.zeros(len(size), np.uint64)
        if len(full):
            one[full] = pair_hash(np.add.reduceat(fmix(flat ^ salt), starts[:-1][full]), size[full].astype(U64))
        out.append(one.view(np.int64))
    return out[0], out[1]


def half_keys(flat: np.ndarray, starts: np.ndarray, rows: int, side: int, seed: int = SEED) -> np.ndarray:
    """(rows of the batch with a set, 2 * side) half keys: the first `side` are one collection, the others the other."""
    at = starts[:-1][np.diff(starts) > 0]
    rng = np.random.default_rng(seed)
    out = np.zeros((len(at), 2 * side), U64)
    for c in range(2 * side):
        key = np.full(len(at), c, U64)
        for _ in range(rows // 2):
            shift, scale = U64(rng.integers(1 << 63)), U64(rng.integers(1 << 62) * 2 + 1)
            key = pair_hash(key, np.minimum.reduceat((flat ^ shift) * scale, at)) if len(at) else key
        out[:, c] = key
    return out


def signatures(docs: DataFrame, doc_id: str, text: str, width: int, rows: int, side: int) -> DataFrame:
    """(doc_id, n_shingles, one, two, halves) of each document; one and two are its class and null for an empty set, as halves is."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                flat, starts = shingle_sets(*as_bytes(block.column(1)), width)
                size, (one, two) = np.diff(starts), class_ids(flat, starts)
                halves = half_keys(flat, starts, rows, side)
                lens = np.where(size > 0, 2 * side, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32)), pa.array(halves.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(size), pa.array(one, mask=size == 0), pa.array(two, mask=size == 0), lists], names=["doc_id", "n_shingles", "one", "two", "halves"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, n_shingles long, one long, two long, halves array<long>")


def _sets(docs: DataFrame, doc_id: str, text: str, width: int, wanted: DataFrame) -> DataFrame:
    """(cls, n, elements) of the classes in `wanted` (one, two, cls, doc), once each.

    Only texts whose id may be a class's smallest, or who have none, are read again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text"):
                flat, starts = shingle_sets(*as_bytes(block.column(0)), width)
                (one, two), size = class_ids(flat, starts), np.diff(starts)
                keep = np.flatnonzero(size)
                keep = keep[np.unique(np.stack([one[keep], two[keep]], 1), axis=0, return_index=True)[1]]
                own = np.concatenate([flat[starts[i] : starts[i + 1]] for i in keep.tolist()]) if len(keep) else flat[:0]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[keep])]).astype(np.int32)), pa.array(own.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(one[keep]), pa.array(two[keep]), pa.array(size[keep]), lists], names=["one", "two", "n", "elements"])

    told, maybe = may_hold(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")), wanted.select("doc"), "doc")
    some = told.where(maybe | F.col("doc").isNull()).select("text").mapInArrow(lean(run), "one long, two long, n long, elements array<long>")
    return some.join(wanted.select("one", "two", "cls"), ["one", "two"]).select("cls", "n", "elements").dropDuplicates(["cls"])


def _verify(pairs: DataFrame, sets: DataFrame, least: int, most: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) that are links, by the full sets; the set of an `a` with more than `most` pairs is dealt to several tasks."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")).where("parts > 1")
    many = broadcast_if(scratch.keep(many, "many"), LEADS)
    parts = F.coalesce("parts", F.lit(1))
    a = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("elements").alias("ea")).join(many, "a", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    b = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("elements").alias("eb"))
    dealt = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    sized = dealt.join(b, "b").join(a, ["a", "part"]).where(100 * F.least("na", "nb") >= least * F.greatest("na", "nb"))
    shared = F.size(F.array_intersect("ea", "eb")).cast("long")
    return sized.select("a", "b", "na", "nb", shared.alias("shared")).where(100 * F.col("shared") >= least * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


class Block:
    """The sets of a bucket's block, which others ask for links."""

    def __init__(self, cls: np.ndarray, label: np.ndarray, sizes: np.ndarray, flat: np.ndarray):
        owner = np.repeat(np.arange(len(cls)), sizes)
        order = np.argsort(flat, kind="stable")
        self.cls, self.label, self.sizes, self.flat, self.owner = cls, label, sizes, flat[order], owner[order]

    def links(self, cls: np.ndarray, label: np.ndarray, sizes: np.ndarray, flat: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(asking class, class of the block) of links between different labels, one for each asking class and label."""
        low = np.searchsorted(self.flat, flat, "left")
        n = np.searchsorted(self.flat, flat, "right") - low
        asker = np.repeat(np.arange(len(cls)), sizes)
        matches = np.cumsum(np.bincount(asker, n, minlength=len(cls)))
        starts, a, b, at = np.concatenate([[0], np.cumsum(sizes)]), [], [], 0
        while at < len(cls):
            upto = max(at + 1, int(np.searchsorted(matches, (matches[at - 1] if at else 0) + MATCHES, "right")))
            part = slice(starts[at], starts[upto])
            many = n[part]
            place = np.repeat(low[part] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            pair, shared = np.unique(np.repeat(asker[part], many) * len(self.cls) + self.owner[place], return_counts=True)
            x, y = pair // len(self.cls), pair % len(self.cls)
            hit = (100 * shared >= least * (self.sizes[y] + sizes[x] - shared)) & (self.label[y] != label[x])
            x, y = x[hit], y[hit]
            once = np.unique(np.stack([x, self.label[y]], 1), axis=0, return_index=True)[1]
            a.append(cls[x[once]])
            b.append(self.cls[y[once]])
            at = upto
        return np.concatenate(a), np.concatenate(b)


def _compare(least: int):
    """Links (a, b) from rows (key, x, asks, cls, label, elements), in this order: of each (key, x) first the block's, then the asking ones, which are streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            key, x, asks, cls, label = (batch.column(k).to_numpy() for k in range(5))
            lists = batch.column(5)
            cut, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            edges = np.flatnonzero((key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (asks[1:] != asks[:-1])) + 1
            for low, high in zip([0, *edges.tolist()], [*edges.tolist(), len(key)]):
                if low == high:
                    continue
                rows = (cls[low:high], label[low:high], np.diff(cut[low : high + 1]), flat[cut[low] : cut[high]])
                if (key[low], x[low]) != at:
                    at, held, block = (key[low], x[low]), [], None
                if not asks[low]:
                    held.append(tuple(part.copy() for part in rows))
                    continue
                if held:
                    block = Block(*(np.concatenate([h[k] for h in held]) for k in range(4)))
                    held = []
                if block is not None:
                    a, b = block.links(*rows, least)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _left_over(members: DataFrame, reps: DataFrame, sets: DataFrame, labels: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between classes of one bucket that are under different labels and were not compared with each other yet."""
    named = members.where(F.col("cls") != F.col("lead")).join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    open_keys = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("many"), F.bit_xor(F.xxhash64("cls")).alias("x1"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("x2")).where("low <> high")
    once = open_keys.groupBy("many", "x1", "x2").agg(F.min("key").alias("key")).select("key")  # buckets of equal members are one
    active = scratch.keep(named.join(once, "key", "left_semi").join(reps.select("cls", "n"), "cls").select("key", "cls", "label", "n"), "active")
    by_label = active.groupBy("key", "label").agg(F.count("*").alias("many"), F.sum("n").alias("elements"))
    buckets = by_label.groupBy("key").agg(F.max_by("label", F.struct("many", "label")).alias("bulk"), F.greatest(F.ceil(F.sum("elements") / BLOCK_ELEMENTS), F.lit(1)).cast("int").alias("parts"))
    rows = active.join(buckets, "key")
    # Each class is in one block that is asked; those outside the bulk ask every block.
    asked = rows.select("key", F.pmod(F.xxhash64("cls"), "parts").cast("int").alias("x"), F.lit(0).alias("asks"), "cls", "label")
    asks = rows.where(F.col("label") != F.col("bulk")).select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("x"), F.lit(1).alias("asks"), "cls", "label")
    placed = asked.unionByName(asks).join(sets.select("cls", "elements"), "cls").select("key", "x", "asks", "cls", "label", "elements")
    return placed.repartition("key", "x").sortWithinPartitions("key", "x", "asks", "cls").mapInArrow(lean(_compare(least)), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE, least: int = LEAST, rows: int = ROWS, side: int = SIDE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs.

    Texts are linked when 100 * shared >= least * united shingles.  component_id is
    the smallest id that links reach, kept says that it is the row's own.  Null and
    empty texts have no shingles and no links.  A null id counts as no id: its component has the
    smallest id of the others, and it is kept only where there is none.  Equal rows
    share a component; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "near")
    signed = scratch.keep(signatures(docs, doc_id, text, width, rows, side), "signed")
    full = signed.where(F.col("one").isNotNull())
    classes = full.groupBy("one", "two").agg(F.first("n_shingles").alias("n"), F.first("halves").alias("halves"), F.min("doc_id").alias("doc"))
    reps = scratch.keep(classes.withColumn("cls", F.monotonically_increasing_id()), "reps")
    keys = F.explode(F.array(*(F.xxhash64(F.lit(i * side + j), F.element_at("halves", i + 1), F.element_at("halves", side + j + 1)) for i in range(side) for j in range(side))))
    keyed = reps.select("cls", "halves").repartition(max(1, -(-reps.count() * side * side // KEYED)), "cls").select("cls", keys.alias("key"))
    leads = keyed.groupBy("key").agg(F.min("cls").alias("lead"), F.count("*").alias("many")).where("many > 1").drop("many")
    members = scratch.keep(keyed.join(leads, "key"), "members")
    wanted = scratch.keep(reps.select("one", "two", "cls", "doc").join(members.select("cls"), "cls", "left_semi"), "wanted")
    sets = scratch.keep(_sets(docs, doc_id, text, width, wanted), "sets")
    pairs = scratch.keep(members.where(F.col("cls") != F.col("lead")).select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct(), "pairs")
    links = scratch.keep(_verify(pairs, sets, least, PAIRS, scratch), "links")
    labels = components(links, scratch, "first")
    more = scratch.keep(_left_over(members, reps, sets, labels, least, scratch), "more")
    if more.limit(1).count():
        labels = components(links.unionByName(more), scratch, "second")
    # A component's smallest id from its classes' smallest, so that rows meet their class only.
    linked = reps.select("cls", "doc").join(labels.select(F.col("node").alias("cls"), "label"), "cls")
    smallest = linked.groupBy("label").agg(F.min("doc").alias("least_id"))
    named = linked.join(smallest, "label").select("cls", "least_id")
    of_class = reps.select("one", "two", "cls", "doc").join(named, "cls", "left").select(F.col("one").alias("class_one"), F.col("two").alias("class_two"), F.coalesce("least_id", "doc").alias("component_id"))
    met = full.join(of_class, (F.col("one") == F.col("class_one")) & (F.col("two") == F.col("class_two"))).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = signed.where(F.col("one").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = scratch.keep(met.unionByName(alone), "out")
    for done in ("signed", "reps", "members", "wanted", "sets", "active", "pairs", "many", "links", "more"):
        scratch.drop(done)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _without(docs: DataFrame, gone: DataFrame, doc_id: str) -> DataFrame:
    """docs whose id is not in `gone`; only those that may be in it are shuffled."""
    told, maybe = may_hold(docs, gone, doc_id)
    return told.where(~maybe).select(*docs.columns).unionByName(told.where(maybe).join(gone, doc_id, "left_anti").select(*docs.columns))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that stay: of each group the one with the smallest id, and all without an id.

    Rows of equal id and text count once; rows of one id with different texts stay together.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    judged = near_duplicates(docs, doc_id, text, **how).where(F.col("doc_id").isNotNull())
    gone = scratch.keep(judged.where(~F.col("kept")).select(F.col("doc_id").alias(doc_id)).distinct(), "gone")
    left = _without(docs, gone, doc_id)
    twice = judged.where("kept").groupBy(F.col("doc_id").alias(doc_id)).agg(F.count("*").alias("rows")).where("rows > 1").select(doc_id)
    if twice.limit(1).count():
        own = fresh(docs, "text_key")
        keyed = left.withColumn(own, F.xxhash64(F.col(text), F.lit(3)))
        left = left.join(twice, doc_id, "left_anti").unionByName(keyed.join(twice, doc_id, "left_semi").dropDuplicates([doc_id, own]).drop(own))
    return left.select(*docs.columns)
