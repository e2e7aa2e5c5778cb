"""Language-model scoring by context-tree weighting over bytes.

Texts are read as lower-cased bytes with an end symbol, each byte as eight binary
decisions.  For every decision node there is a tree over the up to DEPTH bytes before it;
each of its contexts has a Krichevsky-Trofimov estimate, and the weighted
probability of a context is half that estimate's and half the product of its
children's.  The estimates depend on counts alone, so the tree's mixture follows
from the corpus counts of (DEPTH + 1)-byte strings, which Spark adds up over all training
texts.  Scoring uses the mixture's predictions with those counts.

The tree has every context of the training texts.  Strings are dealt out by the NEAR bytes before the symbol, so
that a task weighs whole subtrees; the driver joins their roots and hands back what each subtree's root is worth.
Every string that occurs in a text, to learn from or not, gets its probability in a written table, of which scoring broadcasts
TABLE strings at a time: a larger table means more passes over the texts, and none of it is left out.  Word counts for the
base score are never cut either: words that make up at least 1 / FREQUENT of all are broadcast, at most FREQUENT of them, and all
others are joined.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import Scratch, fresh
from loomwright.llm.vectext import LOWER, NON_SPACE, U64, Words, as_bytes, blocks, fmix, lean

DEPTH, FREQUENT = 5, 1 << 21
#: Bytes by which strings are dealt out, strings that a task weighs on average, and strings that a pass over the texts looks up.
NEAR, WEIGHED, TABLE = 3, 1 << 16, 1 << 21
#: Partial counts that a task holds before it hands them on.
HELD = 3 << 19
#: Bytes of text that are worked on at once: a symbol takes about 60 bytes of arrays.
PIECE = 1 << 19
#: The end symbol among bytes.
END_BYTE = 0xFF
#: The end token's key among words.
END = fmix(np.array([0x5EED], np.uint64)).view(np.int64)[0]


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row of each): every byte and the end symbol with the DEPTH bytes before it, packed; texts start after DEPTH zeros.

    The end symbol is 0xFF, which UTF-8 never has, so a text's own bytes cannot end it.
    """
    lens = np.diff(offsets)
    gap = DEPTH + 1
    out = np.zeros(len(data) + gap * len(lens) + DEPTH + 8, np.uint8)
    row = np.repeat(np.arange(len(lens)), lens)
    out[np.arange(len(data)) + gap * row + DEPTH] = LOWER[data]
    n = len(data) + len(lens)
    symbol_row = np.repeat(np.arange(len(lens)), lens + 1)
    first = np.arange(n) + DEPTH * symbol_row  # rows stand DEPTH + 1 places apart, DEPTH zeros and before them the end symbol of the row before
    windows = np.ndarray((len(out) - 7,), ">u8", out, strides=(1,))  # eight bytes from every place on
    keys = windows[first].astype(np.uint64) >> U64(64 - 8 * (DEPTH + 1))
    keys[offsets[1:] + np.arange(len(lens))] |= U64(END_BYTE)
    return keys, symbol_row


def symbols(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """`padded`, in pieces of at most PIECE bytes where one text is longer."""
    if len(offsets) != 2 or len(data) <= PIECE:
        yield padded(data, offsets)
        return
    for at in range(0, len(data), PIECE):
        start, end = max(at - DEPTH, 0), min(at + PIECE, len(data))
        keys = padded(data[start:end], np.array([0, end - start]))[0][at - start :]
        if end < len(data):
            keys = keys[:-1]
        yield keys, np.zeros(len(keys), np.int64)


def _merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], (np.add.reduceat(counts, at) if len(at) else counts)


def corpus_counts(docs: DataFrame, learn: Column, text: str = "text") -> DataFrame:
    """(kind, key, n): occurrences in the rows to learn from of words and end tokens (kind 0) and of packed byte strings (kind 1), added up in tasks before the shuffle.

    Strings that only other rows have are there with n = 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], []]

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            keys, counts = _merge(held[kind])
            held[kind] = []
            for at in range(0, len(keys), 1 << 16):
                k = keys[at : at + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(counts[at : at + (1 << 16)])], names=["kind", "key", "n"])

        for batch in batches:
            for block in blocks(batch, text, PIECE):
                data, offsets = as_bytes(block.column(0))
                learns = block.column(1).to_numpy(zero_copy_only=False).astype(bool)
                own = Words(data, offsets, NON_SPACE, lower=True)
                words = np.append(own.hashes()[learns[own.rows()]], np.full(int(learns.sum()), END).view(np.uint64))
                del own
                parts = itertools.chain([(0, words, None)], ((1, strings, learns[of]) for strings, of in symbols(data, offsets)))
                for kind, strings, seen in parts:
                    for keys, taught in ((strings, True),) if seen is None else ((strings[seen], True), (strings[~seen], False)):
                        keys, times = np.unique(keys, return_counts=True)
                        held[kind].append((keys, times * taught))
                        if sum(len(k) for k, _ in held[kind]) > HELD:
                            held[kind] = [_merge(held[kind])]
                            if len(held[kind][0][0]) > HELD // 2:
                                yield from out(kind)
        for kind in (0, 1):
            if held[kind]:
                yield from out(kind)

    return docs.select(F.col(text), F.coalesce(learn, F.lit(False)).alias("learns")).mapInArrow(lean(run), "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Slots:
    """Open-addressing table from 64-bit keys to floats, filled and looked up whole arrays at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, kind: type = np.float32):
        self.size, self.count = int(len(keys) * 1.5) + 16, 0
        self.keys, self.values = np.zeros(self.size, np.uint64), np.zeros(self.size, kind)
        self.add(keys, values)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (((fmix(keys) >> U64(32)) * U64(self.size)) >> U64(32)).astype(np.int64)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in the table yet.  A slot holds its key plus one, so 0 is free."""
        self.count += len(keys)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] == 0)
            spot, who = np.unique(at[free], return_index=True)
            put = free[who]
            self.keys[spot], self.values[spot] = keys[left[put]] + U64(1), values[left[put]]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, at = left[stay], at[stay]
            full = self.keys[at] != 0
            at[full] = (at[full] + 1) % self.size

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found)"""
        at, want = self._home(keys), keys + U64(1)
        there = self.keys[at]
        found, values = there == want, self.values[at]
        left = np.flatnonzero(~found & (there != 0))
        while len(left):
            at[left] = (at[left] + 1) % self.size
            there = self.keys[at[left]]
            hit = there == want[left]
            values[left[hit]], found[left[hit]] = self.values[at[left[hit]]], True
            left = left[~hit & (there != 0)]
        return values, found


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2) by Stirling's series, shifted up where n is small."""
    return _log_gamma(n + 0.5)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - shift


def kt_log(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_gamma_half(a) + _log_gamma_half(b) - _log_gamma(a + b + 1.0) - np.log(np.pi)


Level = tuple[np.ndarray, np.ndarray, np.ndarray]


def nodes_of(keys: np.ndarray, counts: np.ndarray) -> Level:
    """Nodes of a depth from its strings: key = context << 8 | bits so far with a leading one; counts of the next bit being 0 and 1."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.float64)
    node, zero, one = [], [], []
    for bit in range(8):
        upto = keys >> U64(8 - bit)
        at = np.flatnonzero(np.concatenate([[True], upto[1:] != upto[:-1]])) if len(keys) else np.zeros(0, np.int64)
        if len(at):
            high = np.add.reduceat(counts * ((keys >> U64(7 - bit)) & U64(1)), at)
            node.append(((keys[at] >> U64(8)) << U64(8)) | U64(1 << bit) | ((keys[at] & U64(255)) >> U64(8 - bit)))
            one.append(high)
            zero.append(np.add.reduceat(counts, at) - high)
    node, zero, one = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((node, np.uint64), (zero, np.float64), (one, np.float64)))
    order = np.argsort(node)
    return node[order], zero[order], one[order]


def _shorter(keys: np.ndarray, depth: int) -> np.ndarray:
    """Strings or nodes with a context of `depth` bytes only."""
    return keys & U64((1 << (8 * (depth + 1))) - 1)


def weigh(levels: list[Level], lowest: int = 0, leaves: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(weighted log probability of the first level's nodes; by level: a node's own share, the place of its parent) for the depths from `lowest` on.

    The last level's weighted probabilities are `leaves`, or else its own estimates.
    """
    weighted = np.zeros(0)
    stop: list[np.ndarray] = [np.zeros(0)] * len(levels)
    parents: list[np.ndarray] = [np.zeros(0, np.int64)] * len(levels)
    for d in range(len(levels) - 1, -1, -1):
        node, zero, one = levels[d]
        own = kt_log(zero, one)
        if d == len(levels) - 1 or not len(levels[d + 1][0]):
            weighted, stop[d] = own if leaves is None or d < len(levels) - 1 else leaves, np.ones(len(node))
            continue
        below, b_zero, b_one = levels[d + 1]
        # A child's parent has one context byte less at the far end.
        up = np.searchsorted(node, _shorter(below, lowest + d))
        parents[d + 1] = up
        n = len(node)
        rest = [np.maximum(x - np.bincount(up, y, minlength=n), 0) for x, y in ((zero, b_zero), (one, b_one))]
        product = np.bincount(up, weighted, minlength=n) + kt_log(*rest)
        weighted = np.logaddexp(own, product) - np.log(2)
        stop[d] = np.exp(own - np.log(2) - weighted)
    return weighted, stop, parents


def mixed(levels: list[Level], stop: list[np.ndarray], parents: list[np.ndarray], gathered: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(P(next bit is 1) by level; what is gathered above each node of the last level, and the weight left to it), from those of the first level."""
    ones: list[np.ndarray] = []
    for d, (_, zero, one) in enumerate(levels):
        if d:
            up = parents[d]
            gathered, weight = gathered[up] + weight[up] * stop[d - 1][up] * estimate[up], weight[up] * (1 - stop[d - 1][up])
        estimate = (one + 0.5) / (zero + one + 1)
        # A path that ends here leaves the rest of the weight to this estimate.
        ones.append(gathered + weight * estimate)
    return ones, gathered, weight


def walk(nodes: list[Slots], keys: np.ndarray) -> np.ndarray:
    """Natural log of P(last byte | bytes before), decision by decision, each at its deepest known context."""
    total = np.zeros(len(keys))
    byte = keys & U64(255)
    for bit in range(8):
        code = U64(1 << bit) | (byte >> U64(8 - bit))
        p, left = np.full(len(keys), 0.5), np.arange(len(keys))
        for d in range(len(nodes) - 1, -1, -1):
            context = (keys[left] >> U64(8)) & U64((1 << (8 * d)) - 1)
            value, found = nodes[d].get((context << U64(8)) | code[left])
            p[left[found]] = value[found]
            left = left[~found]
            if not len(left):
                break
        high = ((byte >> U64(7 - bit)) & U64(1)) == 1
        total += np.log(np.where(high, p, 1 - p))
    return total


class ContextTree:
    """The mixture's predictions in one process, from the strings of each order: orders[k] = (packed k + 1 bytes, counts)."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray]]):
        levels = [nodes_of(*x) for x in orders]
        _, stop, parents = weigh(levels)
        n = len(levels[0][0])
        self.nodes = [Slots(level[0], p) for level, p in zip(levels, mixed(levels, stop, parents, np.zeros(n), np.ones(n))[0])]

    def log_prob(self, keys: np.ndarray) -> np.ndarray:
        return walk(self.nodes, keys)


def _subtrees(keys: np.ndarray, n: np.ndarray) -> list[Level]:
    """The levels from depth NEAR on of the strings that were learnt from."""
    own = (keys[n > 0], n[n > 0])
    return [nodes_of(*_merge([(_shorter(own[0], d), own[1])])) for d in range(NEAR, DEPTH + 1)]


def _gather(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """A partition's strings and counts."""
    parts = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()) for b in batches]
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in ((0, np.uint64), (1, np.int64)))


def _pieces(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(next(iter(columns.values()))), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 16)]) for x in columns.values()], names=list(columns))


def _columns(df: DataFrame) -> list[np.ndarray]:
    """Columns without nulls, as arrays of the driver."""
    got = df.toArrow()
    return [got.column(k).to_numpy() for k in range(got.num_columns)]


def probabilities(strings: DataFrame, total: int) -> DataFrame:
    """(key, p): natural log of the mixture's P(last byte | bytes before) of each of the `total` strings (key, n).

    The roots of the subtrees reach the driver: the nodes of the contexts of NEAR bytes, whose number stops growing
    long before that of the strings.
    """
    near = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << (8 * NEAR)) - 1))
    dealt = strings.select("key", "n").repartition(max(1, -(-total // WEIGHED), int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))), near)

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = _subtrees(*_gather(batches))
        weighted = weigh(levels, NEAR)[0]
        yield from _pieces({"node": levels[0][0].view(np.int64), "zero": levels[0][1], "one": levels[0][2], "weighted": weighted})

    node, zero, one, weighted = _columns(dealt.mapInArrow(lean(roots), "node long, zero double, one double, weighted double"))
    order = np.argsort(node)
    levels, weighted = [(node.view(np.uint64)[order], zero[order], one[order])], weighted[order]
    for d in range(NEAR - 1, -1, -1):
        node, at = np.unique(_shorter(levels[0][0], d), return_inverse=True)
        levels.insert(0, (node, np.bincount(at, levels[0][1], minlength=len(node)), np.bincount(at, levels[0][2], minlength=len(node))))
    _, stop, parents = weigh(levels, 0, weighted)
    ones, gathered, weight = mixed(levels, stop, parents, np.zeros(len(levels[0][0])), np.ones(len(levels[0][0])))
    top = strings.sparkSession.sparkContext.broadcast(([Slots(x[0], p) for x, p in zip(levels[:NEAR], ones)], levels[NEAR][0], gathered, weight))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = _gather(batches)
        if len(keys):
            upper, nodes, gathered, weight = top.value
            levels = _subtrees(keys, n)
            _, stop, parents = weigh(levels, NEAR)
            at = np.searchsorted(nodes, levels[0][0])
            lower = [Slots(x[0], p) for x, p in zip(levels, mixed(levels, stop, parents, gathered[at], weight[at])[0])]
            yield from _pieces({"key": keys.view(np.int64), "p": walk([*upper, *lower], keys).astype(np.float32)})

    return dealt.mapInArrow(lean(leaves), "key long, p float")


#: The worker's part of the table and frequent words, by the pass that they belong to.
_TABLES: dict[str, tuple[Slots, Slots]] = {}


def _tables(at: str, strings: list[np.ndarray], words: np.ndarray, gains: np.ndarray) -> tuple[Slots, Slots]:
    """Made once a worker from what was broadcast."""
    if at not in _TABLES:
        _TABLES.clear()
        _TABLES[at] = (Slots(strings[0].view(np.uint64), strings[1]), Slots(words.view(np.uint64), gains, np.float64))
    return _TABLES[at]


def _tree_score(table: Slots, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What the strings that are in this part of the table add to each row's score."""
    total = np.zeros(len(offsets) - 1)
    for keys, of in symbols(data, offsets):
        value, found = table.get(keys)
        total += np.bincount(of[found], value[found], minlength=len(total))
    return total / np.log(10)


def _another_pass(scored: DataFrame, held: Broadcast, text: str, tree: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, text, PIECE):
                at = block.schema.get_field_index(tree)
                more = _tree_score(_tables(*held.value)[0], *as_bytes(block.column(block.schema.get_field_index(text))))
                yield block.set_column(at, block.schema.field(at), pa.array(block.column(at).to_numpy() + more))

    return scored.mapInArrow(lean(run), scored.schema)


def score(docs: DataFrame, learn: Column, text: str = "text") -> DataFrame:
    """docs without their text, with n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    `learn` says which rows teach the model.  A null text counts as empty: it has
    one token, the end.  Rows are scored one by one, repeats and null ids too; columns of the
    result names are replaced, others pass through.  Without a row to learn from every
    decision has probability 1/2.
    """
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    docs = docs.drop(*names)
    spark = docs.sparkSession
    scratch = Scratch(spark, "context")
    counts = scratch.keep(corpus_counts(docs, learn, text), "counts")
    strings = counts.where("kind = 1").select("key", "n")
    n_strings = strings.count()
    whole = scratch.keep(probabilities(strings, n_strings), "strings")
    passes = max(1, -(-n_strings // TABLE))

    def part_of_table(k: int) -> tuple[str, list[np.ndarray]]:
        return f"{scratch.at}/{k}", _columns(whole.where(F.pmod(F.xxhash64("key"), F.lit(passes)) == k))

    words = counts.where("kind = 0").select(F.col("key").alias("word"), F.col("n").alias("c"))
    n_train, n_kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    heavy_from = max(1, -(-n_train // FREQUENT))
    heavy = words.where(F.col("c") >= heavy_from).toPandas()  # at most FREQUENT words have that share
    floor = float(np.log10(0.5 / (n_train + 0.5 * (n_kinds + 1))))
    gain = np.log10((heavy["c"].to_numpy(np.float64) + 0.5) / 0.5)
    first = held = spark.sparkContext.broadcast((*part_of_table(0), heavy["word"].to_numpy(np.int64), gain))
    rid, rare, times, known, part, tree, size = (fresh(docs, c) for c in ("row_no", "rare", "times", "known", "part", "tree", "size"))
    shaped = docs.withColumns({rid: F.monotonically_increasing_id(), "n_tokens": F.lit(0).cast("long"), known: F.lit(0).cast("long"), part: F.lit(0.0), tree: F.lit(0.0), size: F.lit(0).cast("long"), rare: F.array().cast("array<long>"), times: F.array().cast("array<int>")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, often = _tables(*first.value)
        for batch in batches:
            for block in blocks(batch, text, PIECE):
                n = block.num_rows
                data, offsets = as_bytes(block.column(block.schema.get_field_index(text)))
                own = Words(data, offsets, NON_SPACE, lower=True)
                keys = np.append(own.hashes(), np.full(n, END).view(np.uint64))
                rows = np.append(own.rows(), np.arange(n))
                value, found = often.get(keys)
                seen = np.bincount(rows[found], minlength=n)
                gained = np.bincount(rows[found], value[found], minlength=n).astype(np.float64)  # without words, bincount gives integers
                keys, rows = keys[~found], rows[~found]
                order = np.lexsort((keys, rows))
                keys, rows = keys[order], rows[order]
                at = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])])) if len(keys) else np.zeros(0, np.int64)
                each = np.diff(np.append(at, len(keys)))
                cuts = pa.array(np.searchsorted(rows[at], np.arange(n + 1)).astype(np.int32))
                more = {
                    "n_tokens": pa.array(own.counts + 1),
                    known: pa.array(seen),
                    part: pa.array(gained),
                    tree: pa.array(_tree_score(table, data, offsets)),
                    size: pa.array(np.diff(offsets)),
                    rare: pa.ListArray.from_arrays(cuts, pa.array(keys[at].view(np.int64))),
                    times: pa.ListArray.from_arrays(cuts, pa.array(each.astype(np.int32))),
                }
                yield pa.RecordBatch.from_arrays([more.get(name, block.column(i)) for i, name in enumerate(block.schema.names)], names=block.schema.names)

    scored = shaped.mapInArrow(lean(run), shaped.schema)
    for k in range(1, passes):  # the rest of the table, part by part
        scored = scratch.keep(scored, f"pass{k}")
        if k > 1:
            scratch.drop(f"pass{k - 1}")
        held.unpersist()
        held = spark.sparkContext.broadcast((*part_of_table(k), np.zeros(0, np.int64), np.zeros(0)))
        scored = _another_pass(scored, held, text, tree)
    rows = scratch.keep(scored.drop(text), "rows")
    if passes > 1:
        scratch.drop(f"pass{passes - 1}")
    pairs = rows.select(rid, F.explode(F.arrays_zip(F.col(rare).alias("word"), F.col(times).alias("k"))).alias("p")).select(rid, F.col("p.word").alias("word"), F.col("p.k").alias("k"))
    found = pairs.join(words.where(F.col("c") < heavy_from), "word")
    sum_row, more_known, more_gain = (fresh(rows, c) for c in ("sum_row", "more_known", "more_gain"))
    sums = found.groupBy(F.col(rid).alias(sum_row)).agg(F.sum("k").alias(more_known), F.sum(F.col("k") * F.log10((F.col("c") + 0.5) / 0.5)).alias(more_gain))
    joined = rows.join(sums, rows[rid] == sums[sum_row], "left")
    return joined.withColumns(
        {
            "n_known": F.col(known) + F.coalesce(more_known, F.lit(0)),
            "train_tokens": F.lit(int(n_train)).cast("long"),
            "base_score": F.col("n_tokens") * F.lit(floor) + F.col(part) + F.coalesce(more_gain, F.lit(0.0)),
            "score": F.col(tree),
            "bits_per_byte": -F.col(tree) * float(np.log2(10)) / (F.col(size) + 1),
        }
    ).select(*[c for c in docs.columns if c != text], *names)
