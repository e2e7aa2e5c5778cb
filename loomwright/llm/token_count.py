"""Token counts: Arrow batches in, lengths out.

Texts are cut at ASCII white space, where the normaliser, the pre-tokeniser
and the merges of the vocabulary never reach across, so a text's count is the sum of its pieces'
counts however long the text is.  Equal pieces of a block are encoded once, in
batches of about equal bytes, and a worker remembers the counts of recent pieces
in a table of bounded size.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.vectext import NON_SPACE, Words, as_bytes, blocks, hash_spans, lean

#: Bytes of pieces that one encoder call gets.
BATCH_BYTES = 1 << 20
#: Pieces that a worker remembers, at 12 bytes each.
MEMORY = 1 << 21


class PieceCounter:
    """Token counts of byte pieces by `encode`, each distinct piece once."""

    def __init__(self, encode: Callable[[list[str]], list[int]], memory: int = MEMORY):
        self.encode, self.memory = encode, memory
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def of(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        keys, first, inverse = np.unique(hash_spans(data, starts, lens), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        counts = np.zeros(len(keys), np.int32)
        counts[known] = self.counts[at[known]]
        if len(new := np.flatnonzero(~known)):
            counts[new] = self._encode(data, starts[first[new]], lens[first[new]])
            if len(self.keys) + len(new) > self.memory:
                self.keys, self.counts = keys, counts
            else:
                merged = np.concatenate([self.keys, keys[new]])
                order = np.argsort(merged)
                self.keys, self.counts = merged[order], np.concatenate([self.counts, counts[new]])[order]
        return counts[inverse]

    def _encode(self, data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> list[int]:
        raw, out = data.tobytes(), []
        ends = np.cumsum(lens)
        at = 0
        while at < len(starts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, "right")))
            out += self.encode([raw[s : s + n].decode("utf-8", "replace") for s, n in zip(starts[at:upto].tolist(), lens[at:upto].tolist())])
            at = upto
        return out


_COUNTERS: dict[str, PieceCounter] = {}


def _counter(path: str) -> PieceCounter:
    """The worker's counter for a vocabulary file; .json by tokenizers, .model by sentencepiece."""
    if path not in _COUNTERS:
        if path.endswith(".model"):
            raise ValueError("pieces of sentencepiece models depend on the white space around them; use a .json vocabulary")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _COUNTERS[path] = PieceCounter(lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)])
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", n_bytes: str = "n_bytes", n_tokens: str = "n_tokens") -> DataFrame:
    """`docs` with the UTF-8 length and the token count of `text`.

    A null or empty text has 0 bytes and 0 tokens.  Other columns pass through,
    but ones named like the two results are replaced.  Repeated rows are counted
    each; an empty table stays empty.  Nothing is shuffled.  The vocabulary must be one whose tokens never
    span white space (its normaliser drops it); `path` is read on the executors.
    """
    docs = docs.drop(n_bytes, n_tokens)
    schema = docs.select("*", F.lit(0).cast("long").alias(n_bytes), F.lit(0).cast("long").alias(n_tokens)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for block in blocks(batch, text):
                data, offsets = as_bytes(block.column(block.schema.get_field_index(text)))
                words = Words(data, offsets, NON_SPACE, lower=False)
                sums = np.concatenate([[0], np.cumsum(counter.of(data, words.starts, words.lens), dtype=np.int64)])
                tokens = sums[words.first[1:]] - sums[words.first[:-1]]
                yield pa.RecordBatch.from_arrays([*block.columns, pa.array(np.diff(offsets)), pa.array(tokens)], names=[*block.schema.names, n_bytes, n_tokens])

    return docs.mapInArrow(lean(run), schema)
