"""Benchmark decontamination: a prefix-filtered join of documents with benchmark windows.

Every item is cut into windows of 10 consecutive words (a shorter item is one
window).  A window's words are ordered by rarity in the documents; since a window
must be contained whole, its one rarest word is a sufficient prefix.  Document words that are some
window's prefix give the only candidate places: the prefix's position in its window fixes where the window
would start, the row's bounds must hold its length, and then every word is compared.
Documents stream past the windows, so nothing is shuffled.  The windows are
broadcast in blocks of at most BLOCK; a larger benchmark takes more passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import Scratch, fresh, fresh_prefix
from loomwright.llm.vectext import ALNUM, U64, Words, as_bytes, blocks, fmix, lean, pair_hash

WINDOW = 10
#: Windows broadcast at once: 80 bytes of word hashes each and their item ids, so about 50 MB.
BLOCK = 1 << 18
#: Slices of the items that hold one window.
SLICES = 64
#: Passes over the documents that may be chained in one stage.
CHAIN = 3
_FILTER = U64((1 << 20) - 1)


def item_windows(benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(key, words, items): the distinct windows, their word hashes as bytes, and the sorted ids of the items that hold them.

    Items without an id or without words have no window.  A window has a row for each slice of the items that hold it, so that one
    that all items share is no single array.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                words = Words(*as_bytes(block.column(1)), ALNUM, lower=True)
                h, first, counts = words.hashes(), words.first, words.counts
                row = np.flatnonzero(counts)
                n = np.maximum(counts[row] - width, 0) + 1
                at = np.repeat(first[row], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                size = np.repeat(np.minimum(counts[row], width), n)
                out = [h[a : a + k].astype("<u8").tobytes() for a, k in zip(at.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays([block.column(0).take(pa.array(np.repeat(row, n))), pa.array(out, pa.binary())], names=["item", "words"])

    chosen = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item"), "text")
    each = chosen.mapInArrow(lean(run), "item string, words binary")
    sliced = each.withColumn("slice", F.pmod(F.xxhash64("item"), F.lit(SLICES)))
    return sliced.groupBy("words", "slice").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("key", F.xxhash64("words", "slice")).drop("slice")


class Probe:
    """A block of windows, by prefix word."""

    def __init__(self, windows: list[np.ndarray], items: list[list[str]], counts: dict[int, int]):
        self.items = items
        self.lens = np.array([len(w) for w in windows], np.int64)
        self.words = np.zeros((len(windows), WINDOW if not windows else max(map(len, windows))), U64)
        offset = np.zeros(len(windows), np.int64)
        prefix = np.zeros(len(windows), U64)
        for i, w in enumerate(windows):
            self.words[i, : len(w)] = w
            offset[i] = min(range(len(w)), key=lambda k: (counts.get(int(w[k]), 0), int(w[k]), k))
            prefix[i] = w[offset[i]]
        order = np.argsort(prefix, kind="stable")
        self.keys, self.start = np.unique(prefix[order], return_index=True)
        self.end = np.append(self.start[1:], len(order))
        self.order, self.offset = order, offset
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys & _FILTER).astype(np.int64)] = True

    def hits(self, h: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of every occurrence."""
        none = np.zeros(0, np.int64)
        if not len(self.keys) or not len(h):
            return none, none
        at = np.flatnonzero(self.maybe[(h & _FILTER).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[k] == h[at]
        at, k = at[same], k[same]
        n = self.end[k] - self.start[k]
        window = self.order[np.repeat(self.start[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        at = np.repeat(at, n)
        row = rows[at]
        start = at - self.offset[window]
        fits = (start >= first[row]) & (start + self.lens[window] <= first[row + 1])  # positional and length bounds
        start, window = start[fits], window[fits]
        for j in range(self.words.shape[1]):
            live = self.lens[window] > j
            same = ~live
            same[live] = h[start[live] + j] == self.words[window[live], j]
            start, window = start[same], window[same]
        return start, window


def _word_counts(docs: DataFrame, words: np.ndarray, text: str) -> dict[int, int]:
    """How often each of the given words occurs in the documents; each task adds up before the shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = held.value
        maybe = np.zeros(1 << 20, bool)
        maybe[(keys & _FILTER).astype(np.int64)] = True
        total = np.zeros(len(keys), np.int64)
        for batch in batches:
            for block in blocks(batch, text):
                h = Words(*as_bytes(block.column(0)), ALNUM, lower=True).hashes()
                h = h[maybe[(h & _FILTER).astype(np.int64)]]
                k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                total += np.bincount(k[keys[k] == h], minlength=len(keys))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["word", "n"])

    rows = docs.select(text).mapInArrow(lean(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    return dict(zip(words[rows["word"].to_numpy(np.int64)].tolist(), rows["n"].tolist()))


def mark_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", prefix: str = "", block: int = BLOCK) -> DataFrame:
    """docs with `n_words`, `n_hit` and `items` (sorted ids of the items with an occurring window), named with `prefix`.

    Word classes and windows are those of the module.  Null and empty texts have no
    words and no hits; repeated rows are marked each; other columns pass through; an empty table stays empty, and without windows
    nothing is hit.  A block is `block` (window, item) pairs at most, on average.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "windows")
    windows = scratch.keep(item_windows(benchmark), "windows")
    parts = -(-windows.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0] // block) or 1
    names = [prefix + c for c in ("n_words", "n_hit", "items")]
    docs = docs.drop(*names)
    places = fresh(docs, "hit_words")
    out = docs.withColumns({places: F.lit(b"").cast("binary"), names[2]: F.array().cast("array<string>"), names[0]: F.lit(0).cast("long"), names[1]: F.lit(0).cast("long")})
    schema = out.schema
    for part in range(parts):
        rows = windows.where(F.pmod(F.col("key"), F.lit(parts)) == part).select("words", "items").toPandas()
        own = [np.frombuffer(w, "<u8") for w in rows["words"]]
        words = np.unique(np.concatenate(own)) if own else np.zeros(0, U64)
        counts = _word_counts(docs, words, text) if len(words) else {}
        probe = spark.sparkContext.broadcast(Probe(own, [list(x) for x in rows["items"]], counts))

        def run(batches: Iterator[pa.RecordBatch], probe=probe) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in blocks(batch, text):
                    yield _mark(piece, probe.value, text, places, names)

        out = out.mapInArrow(lean(run), schema)
        if part % CHAIN == CHAIN - 1 and part + 1 < parts:
            out = scratch.keep(out, f"pass{part}")
    return out.drop(places)


def _mark(piece: pa.RecordBatch, probe: Probe, text: str, places: str, names: list[str]) -> pa.RecordBatch:
    field = piece.schema.get_field_index
    words = Words(*as_bytes(piece.column(field(text))), ALNUM, lower=True)
    rows, first = words.rows(), words.first
    start, window = probe.hits(words.hashes(), first, rows)
    cover = np.zeros(len(rows) + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + probe.lens[window], -1)
    hit = np.cumsum(cover[:-1]) > 0
    old_places, old_items = piece.column(field(places)), piece.column(field(names[2]))
    pairs = np.unique(rows[start] * (len(probe.lens) or 1) + window) if len(start) else np.zeros(0, np.int64)
    found: dict[int, set] = {}
    for code in pairs.tolist():
        found.setdefault(code // len(probe.lens), set()).update(probe.items[code % len(probe.lens)])
    new_places, new_items = [], []
    for i in range(piece.num_rows):
        before, items = old_places[i].as_py(), old_items[i].as_py()
        own = hit[first[i] : first[i + 1]]
        if before:
            own = own.copy()
            own[np.frombuffer(before, "<i4")] = True
        new_places.append(np.flatnonzero(own).astype("<i4").tobytes() if i in found or before else b"")
        new_items.append(sorted({*items, *found[i]}) if i in found else items)
    more = {places: pa.array(new_places, pa.binary()), names[2]: pa.array(new_items, pa.list_(pa.string())), names[0]: pa.array(words.counts), names[1]: pa.array([len(x) // 4 for x in new_places], pa.int64())}
    return pa.RecordBatch.from_arrays([more.get(n, piece.column(i)) for i, n in enumerate(piece.schema.names)], names=piece.schema.names)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents without a hit, with their own columns.

    Null and empty texts have none and stay, as all do without windows; repeated rows fare alike; an empty table stays empty.
    """
    prefix = fresh_prefix(docs, "hits_")
    return mark_hits(docs, benchmark, text, prefix).where(F.col(prefix + "n_hit") == 0).select(*docs.columns)
