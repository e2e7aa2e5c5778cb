"""Quality classifier: a linear support vector machine over naive-Bayes features.

A text's features are indicators of its word unigrams and bigrams and of the
unigrams and bigrams of word shapes (first and last byte class, capitals inside, repeats).  Each
indicator is scaled by its class log-count ratio, texts are scaled to
unit length, and dual coordinate descent fits the hinge loss.  A sigmoid fitted on
margins of rows left out of that fit turns margins into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.vectext import NON_SPACE, Words, as_bytes, blocks, lean, pair_hash

BUCKETS = 1 << 18
#: Labelled documents of each class that the fit reads at most.
PER_CLASS = 6000
COST, EPOCHS, SMOOTH = 1.0, 12, 1.0
#: A round that moves no multiplier further ends the fit.
SETTLED = 1e-3
#: Byte classes of shapes: 0 lower-case, 1 capital, 2 digit, 3 sentence mark, 4 "!" or "?", 5 other symbol, 6 non-ASCII.
_SHAPE = np.full(256, 5, np.uint64)
_SHAPE[ord("a") : ord("z") + 1] = 0
_SHAPE[ord("A") : ord("Z") + 1] = 1
_SHAPE[ord("0") : ord("9") + 1] = 2
_SHAPE[list(b".,;:'\"()-")] = 3
_SHAPE[list(b"!?")] = 4
_SHAPE[128:] = 6


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct features of each row, by row and bucket."""
    words = Words(data, offsets, NON_SPACE, lower=False)
    if not len(words.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, h = words.rows(), words.hashes()
    capitals = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    inner = capitals[words.starts + words.lens] - capitals[words.starts + 1]
    same = np.zeros(len(h), np.uint64)
    same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    shape = _SHAPE[data[words.starts]] | _SHAPE[data[words.starts + words.lens - 1]] << np.uint64(3) | np.minimum(inner, 2).astype(np.uint64) << np.uint64(6) | same << np.uint64(8)
    pair = rows[1:] == rows[:-1]
    one = np.uint64(1)
    keys = [h, pair_hash(h[:-1], h[1:])[pair], pair_hash(shape, np.full(len(h), one)), pair_hash(pair_hash(shape[:-1], shape[1:]), np.full(len(h) - 1, one + one))[pair]]
    owner = np.concatenate([rows, rows[1:][pair], rows, rows[1:][pair]])
    both = np.unique(owner * BUCKETS + (np.concatenate(keys) & np.uint64(BUCKETS - 1)).astype(np.int64))
    return both // BUCKETS, both % BUCKETS


def log_count_ratio(buckets: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """log of the smoothed share of each bucket among the positive texts' features over that among the negative ones'."""
    p = SMOOTH + np.bincount(buckets[positive], minlength=BUCKETS)
    q = SMOOTH + np.bincount(buckets[~positive], minlength=BUCKETS)
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge loss by dual coordinate descent; y is -1 or 1, the bias a constant feature."""
    w, b, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    norm = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at, v = rows[i], values[i]
            slope = y[i] * (w[at] @ v + b) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                b += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < SETTLED:
            break
    return w, b


def sigmoid_fit(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the logistic curve of y on margin, by damped Newton steps with smoothed targets."""
    n1, n0 = (weight * (y == 1)).sum(), (weight * (y != 1)).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        g = weight * (p - target)
        h = weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * margin).sum(), g.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, c = max(a - step[0], 1e-3), c - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(c)


@dataclass
class Model:
    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, rows: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        v = self.ratio[buckets].astype(np.float64)
        length = np.sqrt(np.bincount(rows, v * v, minlength=n))
        return np.bincount(rows, v * self.weights[buckets], minlength=n) / np.maximum(length, 1e-9) + self.bias

    def scores(self, rows: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(rows, buckets, n) + self.offset, -30, 30)))


def fit(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> Model:
    """Model of bucket lists.  Each half of the rows is left out once, and the margins that the other half's model gives it fit the sigmoid."""

    def svm(use: np.ndarray) -> Model:
        own = [rows[i] for i in use]
        ratio = log_count_ratio(np.concatenate(own), np.repeat(y[use] == 1, [len(x) for x in own]))
        ratio = ratio.astype(np.float32)
        values = [ratio[x] / max(np.linalg.norm(ratio[x]), 1e-9) for x in own]
        w, b = descend(own, values, np.where(y[use] == 1, 1.0, -1.0), COST * weight[use])
        return Model(ratio, w.astype(np.float32), float(b))

    every = np.arange(len(y))
    margins = np.zeros(len(y))
    for part in range(2):
        out = every % 2 == part
        half = svm(every[~out])
        lens = [len(rows[i]) for i in every[out]]
        margins[out] = half.margins(np.repeat(np.arange(out.sum()), lens), np.concatenate([rows[i] for i in every[out]]), int(out.sum()))
    model = svm(every)
    model.slope, model.offset = sigmoid_fit(margins, y, weight)
    return model


def train(sample: DataFrame, sizes: dict[int, int]) -> Model:
    """The model of a `labelled_sample`; classes weigh as in all labels.  With labels of one class only, or none, every score is the smoothed share of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                rows, buckets = features(*as_bytes(block.column(0)))
                cut = np.searchsorted(rows, np.arange(block.num_rows + 1))
                one = buckets.astype("<i4")
                yield pa.RecordBatch.from_arrays([block.column(1), pa.array([one[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], names=["y", "buckets"])

    got = sample.select("text", F.col("y").cast("int")).mapInArrow(lean(run), "y int, buckets binary").toPandas()
    y = got["y"].to_numpy(np.int64)
    taken = np.bincount(y, minlength=2)
    if min(taken) < 1:
        share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
        return Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    weight = np.array([sizes.get(0, 0) / taken[0], sizes.get(1, 0) / taken[1]])[y]
    order = np.lexsort((y, [hash(x) & 0xFFFF for x in map(len, got["buckets"])], [np.frombuffer(x, "<i4").sum() if len(x) else 0 for x in got["buckets"]]))
    return fit([np.frombuffer(got["buckets"][i], "<i4") for i in order], y[order], (weight / weight.mean())[order])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `score`, the probability of label 1.

    A null or empty text has no features and gets the bias's score; repeated rows have equal scores; an empty table stays empty.  A
    column named score is replaced, others pass through; rows stay and nothing is shuffled.
    """
    docs = docs.drop("score")
    schema = docs.select("*", F.lit(0.0).alias("score")).schema
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, text):
                rows, buckets = features(*as_bytes(block.column(block.schema.get_field_index(text))))
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(held.value.scores(rows, buckets, block.num_rows))], names=[*block.schema.names, "score"])

    return docs.mapInArrow(lean(run), schema)
