"""Main text of HTML pages: a linear-chain conditional random field over DOM leaf blocks.

A block's features are the tags and the class, id and role words of its ancestors, its own element's, and the shape of its text.  Steps
between blocks have weights of their own, by whether both lie in one element.  Weights maximise the regularised likelihood of labelled pages; Viterbi decodes
the most likely labels of all blocks of a page together.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.dom_blocks import Block, Page, read
from loomwright.llm.layouts import labelled_pages
from loomwright.llm.vectext import blocks, lean

#: Labelled pages that the default model is trained on, their seed, rounds of training, and pages a feature has to be on.
PAGES, SEED, ROUNDS, LEAST = 2000, 20, 150, 3
#: Strength of the regularisation, a share of the squared weights for each page.
DECAY = 0.003
#: Kinds of steps from a block to the next: within one element, to an element of the same marks beside it, to another one beside it, or elsewhere.
STEPS = 4


def _size(n: int, *bounds: int) -> int:
    return sum(n >= b for b in bounds)


def features(page: Page) -> Iterator[list[str]]:
    """The features of each block of a page."""
    n, title = len(page.blocks), page.title
    long = max((len(b.text) for b in page.blocks), default=0)
    for i, b in enumerate(page.blocks):
        text, own = b.text, b.own[0] if b.own else "<"
        linked = _size(100 * b.linked, 1, 25 * len(text), 60 * len(text), 95 * len(text))
        size = _size(len(text), 4, 10, 25, 60, 120, 250, 600)
        ends, marks = text[-1] in ".!?…:。”\"", sum(map(text.count, ".!?,;"))
        found = [f"anc{m}" for m in b.around]
        found += [f"own{m}" for m in b.own]
        found += [f"size{size}", f"link{linked}", f"size{size}link{linked}", f"{own}size{size}", f"{own}link{linked}", f"ends{ends}size{size}", f"marks{_size(marks, 1, 3, 8)}"]
        found.append(f"at{_size(20 * i, 1, 2 * n, 10 * n, 18 * n)}{i == n - 1}")
        if len(text) == long:
            found.append("longest")
        if title and len(text) > 3 and (title.startswith(text[:40]) or text.startswith(title[:40])):
            found += ["title", f"title{own}"]
        if "©" in text or "(c)" in text.lower():
            found.append("copyright")
        if not b.own:
            found.append("bare")
        if len(text) <= 40:
            found += [f"word {w}" for w in text.lower().replace(".", " ").split()[:6]]
        yield found


def _outside(block: Block) -> tuple[str, ...]:
    return block.around[: len(block.around) - len(block.own)]


def steps(page: Page) -> np.ndarray:
    """The kind of the step into each block but the first."""
    pairs = zip(page.blocks, page.blocks[1:])
    return np.array([0 if a.element == b.element else 3 if _outside(a) != _outside(b) else 1 if a.own == b.own else 2 for a, b in pairs], np.int64)


def labels(page: Page, text: str) -> np.ndarray:
    """1 for the blocks that the main text is made of, matched in page order."""
    out, at = np.zeros(len(page.blocks), np.int64), 0
    for i, b in enumerate(page.blocks):
        stop = at + len(b.text)
        if text[at:stop] == b.text and text[stop : stop + 1] in ("", " "):
            out[i], at = 1, stop + 1
    return out


class ChainModel:
    """Weights of a chain of blocks with labels 0 and 1: `names` are the features, `emit` their weights for label 1, `move[kind, a, b]` those of steps."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    def scores(self, page: Page) -> np.ndarray:
        get, emit = self.names.get, self.emit
        return np.array([sum(emit[k] for f in found if (k := get(f)) is not None) for found in features(page)], float)

    def decode(self, page: Page) -> np.ndarray:
        """The most likely labels of a page's blocks, by Viterbi."""
        if not page.blocks:
            return np.zeros(0, np.int64)
        scores, move, kinds = self.scores(page).tolist(), self.move.tolist(), steps(page).tolist()
        zero, one, back = 0.0, scores[0], []
        for score, kind in zip(scores[1:], kinds):
            (stay0, up), (down, stay1) = move[kind]
            back.append((one + down > zero + stay0, one + stay1 >= zero + up))
            zero, one = max(zero + stay0, one + down), max(zero + up, one + stay1) + score
        out, label = np.zeros(len(scores), np.int64), int(one > zero)
        for i in range(len(scores) - 1, -1, -1):
            out[i] = label
            if i:
                label = int(back[i - 1][label])
        return out

    def text(self, html: str | None) -> str:
        page = read(html)
        return " ".join(b.text for b, label in zip(page.blocks, self.decode(page)) if label)


class _Batch:
    """Pages of a training set laid out by position, so that all chains advance together."""

    def __init__(self, pages: list[tuple[Page, np.ndarray]], names: dict[str, int]):
        pages = sorted((p for p in pages if p[0].blocks), key=lambda p: -len(p[0].blocks))
        self.lengths = np.array([len(p.blocks) for p, _ in pages], np.int64)
        first = np.r_[0, np.cumsum(self.lengths)]
        self.n = int(first[-1])
        rows = [[names[f] for f in found if f in names] for p, _ in pages for found in features(p)]
        self.feature = np.array([k for r in rows for k in r], np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.y = np.concatenate([y for _, y in pages])
        kind = np.full(self.n, -1)
        for at, (p, _) in zip(first, pages):
            kind[at + 1 : at + len(p.blocks)] = steps(p)
        # Blocks at position t of all chains that are so long.
        self.at = [first[:-1][: int((self.lengths > t).sum())] + t for t in range(int(self.lengths.max(initial=0)))]
        self.kind = kind
        inside = np.flatnonzero(kind >= 0)
        self.seen = np.zeros((STEPS, 2, 2))
        np.add.at(self.seen, (kind[inside], self.y[inside - 1], self.y[inside]), 1)

    def gradient(self, emit: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood of the labels and its gradient, by forward and backward sums."""
        score = np.zeros((self.n, 2))
        score[:, 1] = np.bincount(self.row, emit[self.feature], self.n)
        ahead, behind = np.zeros((self.n, 2)), np.zeros((self.n, 2))
        for t, rows in enumerate(self.at):
            ahead[rows] = score[rows] + (np.logaddexp.reduce(ahead[rows - 1][:, :, None] + move[self.kind[rows]], 1) if t else 0)
        for rows in reversed(self.at[1:]):
            behind[rows - 1] = np.logaddexp.reduce(move[self.kind[rows]] + (score[rows] + behind[rows])[:, None, :], 2)
        z = np.logaddexp.reduce(ahead[self.at[0] + self.lengths - 1], 1)
        total = np.repeat(z, self.lengths)
        likely = np.exp(ahead + behind - total[:, None])[:, 1]
        inside = np.flatnonzero(self.kind >= 0)
        pair = np.exp(ahead[inside - 1][:, :, None] + move[self.kind[inside]] + (score[inside] + behind[inside])[:, None, :] - total[inside][:, None, None])
        expected = np.zeros((STEPS, 2, 2))
        np.add.at(expected, self.kind[inside], pair)
        truth = (score[np.arange(self.n), self.y]).sum() + (move * self.seen).sum()
        return truth - z.sum(), np.bincount(self.feature, (self.y - likely)[self.row], len(emit)), self.seen - expected


def train(pages: Iterable[tuple[str, str]], rounds: int = ROUNDS, least: int = LEAST, decay: float = DECAY) -> ChainModel:
    """A model of labelled pages (html, main text), of which the caller bounds the number; they are held on the driver.

    Features on fewer than `least` pages are left out.  Without pages or blocks nothing is learned and every page's text is empty.
    """
    read_pages = [(page, labels(page, text)) for html, text in pages for page in (read(html),)]
    seen = Counter(f for page, _ in read_pages for f in {f for found in features(page) for f in found})
    names = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= least))}
    emit, move = np.zeros(len(names)), np.zeros((STEPS, 2, 2))
    if not any(page.blocks for page, _ in read_pages):
        return ChainModel(names, emit, move)
    batch = _Batch(read_pages, names)
    # Steps of Adam; the mean of moments evens out rare and common features.
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (emit, move)]
    for turn in range(1, rounds + 1):
        _, *grads = batch.gradient(emit, move)
        for w, g, (m, v) in zip((emit, move), grads, moments):
            g = g - decay * w * np.sqrt(len(read_pages))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.12 * (1 - turn / (rounds + 1)) * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return ChainModel(names, emit, move)


@functools.cache
def default_model() -> ChainModel:
    return train(labelled_pages(PAGES, SEED))


def extract(pages: DataFrame, model: ChainModel, html: str = "html", text: str = "text") -> DataFrame:
    """pages with their main text as a last column `text`, in place of `html`: the main blocks in page order, joined by single spaces.

    The whole page is read.  Null and empty pages, and those without a main block, have an empty text; white space in a block becomes one space.
    Repeated rows have equal texts; an empty table stays empty; all other columns pass through, but one named like `text` is replaced.
    """
    names = [c for c in pages.columns if c not in (html, text)]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, html, 1 << 20):
                found = pa.array([model.text(page.as_py()) for page in block.column(len(names))], pa.string())
                yield pa.RecordBatch.from_arrays([*block.columns[:-1], found], [*names, text])

    return pages.select(*names, html).mapInArrow(run, pages.select(*names).withColumn(text, F.lit("")).schema)
