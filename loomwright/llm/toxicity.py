"""Toxicity by multiple-instance learning.

A sentence is an instance, a document its bag.  A sentence's score is a logistic function
of the weights of its words and of their beginnings, a document's the noisy-or of its sentences,
1 - prod(1 - p).  Only documents are labelled; the weights maximise
the likelihood of those labels, so the sentences that explain a label are found on
the way and can be located afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.vectext import ALNUM, Words, as_bytes, blocks, hash_spans, lean, pair_hash

BUCKETS = 1 << 20
#: Labelled documents that the fit reads at most: not toxic, toxic.
PER_CLASS = (6000, 3000)
#: Features that are worked on at once.
PIECE = 1 << 20
#: Rounds and step of the fit, the fewest documents of a feature, and the first bias.
ROUNDS, RATE, LEAST_DOCS, START = 150, 0.2, 3, -5.0
#: The pull that a weight has to outdo (its L1 penalty): a share of the toxic documents, 2 documents at most.
SHARE, MOST = 1 / 300, 2.0
#: A word's features: the word itself and its first 4 and 6 bytes.
PREFIXES = (4, 6)
WIDTH = 1 + len(PREFIXES)
_STOPS = np.isin(np.arange(256), list(b".!?\n"))


@dataclass
class NoisyOr:
    """Word weights by hash bucket, and the bias that every sentence has."""

    weights: np.ndarray
    bias: float

    def sentence_scores(self, buckets: np.ndarray, starts: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.bias + np.add.reduceat(self.weights[buckets].astype(np.float64), starts * WIDTH), -30, 30)))


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """(words, WIDTH buckets of each word, index of each sentence's first word, row of each sentence).

    A sentence ends at . ! ? or a line end, or with its text; one without words is none.
    """
    words = Words(data, offsets, ALNUM, lower=True)
    rows = words.rows()
    stops = np.concatenate([[0], np.cumsum(_STOPS[data])]) if len(data) else np.zeros(1, np.int64)
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (stops[words.starts[1:]] > stops[words.starts[:-1] + words.lens[:-1]])
    starts = np.flatnonzero(new)
    kinds = [words.hashes(), *(pair_hash(hash_spans(words.data, words.starts, np.minimum(words.lens, k)), np.full(len(rows), k, np.uint64)) for k in PREFIXES)]
    return words, (np.stack(kinds, 1).ravel() & np.uint64(BUCKETS - 1)).astype(np.int64), starts, rows[starts]


def _bag(logs: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return -np.expm1(np.bincount(rows, logs, minlength=n))


def fit(documents: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray) -> NoisyOr:
    """Proximal Adam on the weighted log likelihood of the labels of documents (buckets, buckets in each sentence).

    The L1 penalty keeps weights at 0 unless more than the penalty's worth of
    pull is left unexplained by the others.  Takes about 12 bytes a feature, and the list of documents, which is empty afterwards.
    """
    in_documents = np.zeros(BUCKETS, np.int32)
    for buckets, _ in documents:
        in_documents[np.unique(buckets)] += 1
    # Features of too few documents have no weight; the others are numbered afresh.
    frequent = np.flatnonzero(in_documents >= LEAST_DOCS)
    number = np.full(BUCKETS, -1, np.int32)
    number[frequent] = np.arange(len(frequent))
    # By feature, so that a feature's sentences lie together: those of weight 0 add nothing, and a feature's pull is one sum.
    # A feature and its sentence are one number, sorted in place; the documents are let go of as they are taken.
    sizes = [len(lens) for _, lens in documents]
    pairs, done, filled = np.empty(sum(len(buckets) for buckets, _ in documents), np.uint64), 0, 0
    for at, (buckets, lens) in enumerate(documents):
        documents[at] = None
        index = number[buckets]
        used = index >= 0
        owner = np.repeat(np.arange(done, done + len(lens), dtype=np.uint64), lens)[used]
        pairs[filled : filled + len(owner)] = index[used].astype(np.uint64) << np.uint64(32) | owner
        filled, done = filled + len(owner), done + len(lens)
    pairs = pairs[:filled]
    pairs.sort()
    rows = np.repeat(np.arange(len(y)), sizes)
    owner, many = np.empty(filled, np.int32), np.zeros(len(frequent), np.int64)
    for at in range(0, filled, PIECE):
        piece = pairs[at : at + PIECE]
        owner[at : at + PIECE] = piece & np.uint64(0xFFFFFFFF)
        many += np.bincount((piece >> np.uint64(32)).astype(np.int64), minlength=len(frequent))
    del pairs
    starts = np.concatenate([[0], np.cumsum(many)])
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, starts[-1], PIECE)), len(frequent)))
    pieces = [(low, high) for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if starts[high] > starts[low]]
    w, b, total = np.zeros(len(frequent)), START, weight.sum()
    penalty = min(MOST, SHARE * (y == 1).sum())
    m, v = np.zeros(len(frequent) + 1), np.zeros(len(frequent) + 1)
    for step in range(1, ROUNDS + 1):
        z = np.zeros(done)
        for low, high in pieces:
            used = low + np.flatnonzero(w[low:high])
            lens = many[used]
            place = np.repeat(starts[used] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            np.add.at(z, owner[place], np.repeat(w[used], lens))
        z = np.clip(b + z, -30, 30)
        p = 1 / (1 + np.exp(-z))
        bag = np.clip(_bag(np.log1p(-np.minimum(p, 1 - 1e-12)), rows, len(y)), 1e-6, 1 - 1e-9)
        pull = (weight * np.where(y == 1, (1 - bag) / bag, -1.0))[rows] * p
        slope = np.zeros(len(frequent) + 1)
        for low, high in pieces:
            slope[low:high] = np.add.reduceat(pull[owner[starts[low] : starts[high]]], starts[low:high] - starts[low])
        slope[-1] = pull.sum()
        slope /= total
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        scale = RATE / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        move = m / (1 - 0.9**step) * scale
        moved = w + move[:-1]
        w, b = np.sign(moved) * np.maximum(np.abs(moved) - scale[:-1] * penalty / total, 0), b + move[-1]
    documents.clear()
    weights = np.zeros(BUCKETS, np.float32)
    weights[frequent] = w
    return NoisyOr(weights, float(b))


def train(sample: DataFrame, sizes: dict[int, int]) -> NoisyOr:
    """The model of a `labelled_sample`; classes weigh as in all labels.  Without labels of both classes every weight is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                words, bucket, starts, rows = sentences(*as_bytes(block.column(0)))
                ends = np.append(starts * WIDTH, len(bucket))
                cut = np.searchsorted(rows, np.arange(block.num_rows + 1))
                one = bucket.astype("<i4")
                yield pa.RecordBatch.from_arrays(
                    [block.column(1), pa.array([one[ends[a] : ends[b]].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()), pa.array([np.diff(ends[a : b + 1]).astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                    names=["y", "buckets", "lens"],
                )

    rows = sample.select("text", F.col("y").cast("int")).mapInArrow(lean(run), "y int, buckets binary, lens binary").toArrow()
    y = rows["y"].to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        return NoisyOr(np.zeros(BUCKETS, np.float32), START)
    taken = np.bincount(y, minlength=2)
    weight = np.array([sizes.get(0, 0) / taken[0], sizes.get(1, 0) / taken[1]])[y]
    # Views of the columns, so nothing is held twice; a chunk goes with the last document in it.
    documents = [(np.frombuffer(b.as_buffer(), "<i4"), np.frombuffer(n.as_buffer(), "<i4")) for b, n in zip(rows["buckets"], rows["lens"])]
    del rows
    return fit(documents, y, weight / weight.mean())


def score(docs: DataFrame, model: NoisyOr, text: str = "text") -> DataFrame:
    """docs with `score` (noisy-or of the sentences), `n_sentences` and `n_offending` (sentences of 0.5 or more).

    A null or empty text has no sentence and the score 0; repeated rows have equal scores; an empty table stays empty.  Columns of
    these names are replaced, others pass through; rows stay as they are and nothing is shuffled.
    """
    names = ["score", "n_sentences", "n_offending"]
    docs = docs.drop(*names)
    schema = docs.select("*", F.lit(0.0).alias(names[0]), F.lit(0).cast("long").alias(names[1]), F.lit(0).cast("long").alias(names[2])).schema
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, text):
                _, buckets, starts, rows = sentences(*as_bytes(block.column(block.schema.get_field_index(text))))
                p = held.value.sentence_scores(buckets, starts)
                n = block.num_rows
                more = [_bag(np.log1p(-p), rows, n), np.bincount(rows, minlength=n), np.bincount(rows[p >= 0.5], minlength=n)]
                yield pa.RecordBatch.from_arrays([*block.columns, *map(pa.array, more)], names=[*block.schema.names, *names])

    return docs.mapInArrow(lean(run), schema)


def offending_sentences(docs: DataFrame, model: NoisyOr, least: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sentence_no, start, end, score, sentence) of the sentences that score `least` or more; offsets are code points, end exclusive."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                data, offsets = as_bytes(block.column(1))
                words, bucket, starts, rows = sentences(data, offsets)
                p = held.value.sentence_scores(bucket, starts)
                last = np.append(starts[1:], len(words.starts)) - 1
                hit = np.flatnonzero(p >= least)
                low, high = words.starts[starts[hit]], words.starts[last[hit]] + words.lens[last[hit]]
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = points[offsets[rows[hit]]]
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [block.column(0).take(pa.array(rows[hit])), pa.array(hit - np.searchsorted(rows, rows[hit])), pa.array(points[low] - base), pa.array(points[high] - base), pa.array(p[hit]), pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(low, high)], pa.string())],
                    names=["doc_id", "sentence_no", "start", "end", "score", "sentence"],
                )

    kind = dict(chosen.dtypes)["doc_id"]
    return chosen.mapInArrow(lean(run), f"doc_id {kind}, sentence_no long, start long, end long, score double, sentence string")
