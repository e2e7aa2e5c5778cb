"""Words of a block of texts as dense codes, and counts by string key in packed rows.

Codes and keys are exact: equal ones mean equal words, whatever their hashes.  A packed row holds all keys that a block counts for
one (group, bucket), joined by line ends, so a shuffle carries few rows, and a bucket, which takes its keys by hash, is merged
by one task with a bounded share of them.  Rows are at most a block's keys, and far fewer while buckets hold many of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.vectext import Words, as_bytes, hash_spans

#: Bytes that are gathered at once.
GATHER = 1 << 19


class Coded(Words):
    """Words of a text column with `codes`, an index into `names`, a string array of the distinct words; A-Z are lower-cased."""

    def __init__(self, column: pa.Array, table: np.ndarray):
        super().__init__(*as_bytes(column), table, lower=True)
        self.ends = np.zeros(len(self.lens) + 1, np.int64)
        np.cumsum(self.lens, out=self.ends[1:])
        self.bytes = self.data[table[self.data]]
        coded = strings(self.bytes, self.ends).dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.names = coded.dictionary


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(data)])


def row_codes(*columns: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
    """A code for each row's values in all columns together, from 0 without gaps, and each column's values by code."""
    codes = np.zeros(len(columns[0]), np.int64)
    for column in columns:
        coded = column.dictionary_encode()
        codes = codes * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False)
    _, first, codes = np.unique(codes, return_index=True, return_inverse=True)
    return codes, [column.take(pa.array(first)) for column in columns]


def edges(key: np.ndarray) -> np.ndarray:
    """Where a sorted key changes, its start included."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def sums(codes: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The sum of `values` by code, in whole numbers."""
    out = np.zeros(size, np.int64)
    np.add.at(out, codes, values)
    return out


def key_hashes(keys: pa.Array) -> np.ndarray:
    data, offsets = as_bytes(keys)
    return hash_spans(data, offsets[:-1], np.diff(offsets))


def n_buckets(docs: DataFrame, text: str, size: int) -> int:
    """How many buckets the counts of these texts take, with one for each `size` bytes of text."""
    return 1 + docs.select(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0] // size


def gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of stretches of `data` one after another; indices are made for some stretches at a time."""
    offsets = np.r_[0, np.cumsum(size)]
    out, at = np.empty(offsets[-1], data.dtype), 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GATHER, "right")) - 1)
        part = slice(offsets[at], offsets[stop])
        out[part] = data[np.repeat(begin[at:stop] - offsets[at:stop], size[at:stop]) + np.arange(part.start, part.stop)]
        at = stop
    return out


def spaced(keys: pa.Array, by: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all keys with the byte `by` behind each, and where each begins."""
    data, offsets = as_bytes(keys)
    if not len(data):
        return np.full(len(keys), by, np.uint8), np.arange(len(keys) + 1)
    begin = offsets + np.arange(len(offsets))
    # A key and the byte after it, which is the next key's; the last key has none.
    out = gather(np.r_[data, np.uint8(by)], offsets[:-1], np.diff(offsets) + 1)
    out[begin[1:] - 1] = by
    return out, begin


def joined(keys: pa.Array, start: np.ndarray) -> pa.Array:
    """One string for each stretch of keys that begins at `start`, every key followed by a line end, which no key holds."""
    data, begin = spaced(keys, 10)
    return strings(data, begin[np.r_[start, len(keys)]])


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The keys of joined strings, and how many each string has."""
    data, offsets = as_bytes(column)
    stop = np.flatnonzero(data == 10)
    ends = np.r_[0, stop + 1] - np.arange(len(stop) + 1)
    return strings(data[data != 10], ends), np.diff(np.searchsorted(stop, offsets))


def lists(start: np.ndarray, values: np.ndarray) -> pa.Array:
    """One list for each stretch of values that begins at `start`."""
    return pa.ListArray.from_arrays(pa.array(np.r_[start, len(values)].astype(np.int32)), pa.array(values))


def flat(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False)


def whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.cast(pa.large_string()).chunks) if column.num_chunks else pa.array([], pa.large_string())


def result(columns: dict[str, pa.Array]) -> pa.Table:
    """A table with plain strings, which is what a grouped function has to return."""
    return pa.table({name: column.cast(pa.string()) if pa.types.is_large_string(column.type) else column for name, column in columns.items()})
