"""Vectorised word scanning and hashing over whole Arrow batches of text.

Every Python-side operator of this subpackage reads text through this module.
A batch of strings is viewed as one byte buffer plus offsets; words are byte
runs found with table lookups, and each word gets a 64-bit hash from 8-byte
lanes, so no per-word Python object is ever made.  Texts are taken whole:
`blocks` cuts a batch between rows, never inside one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Multipliers of the 64-bit finaliser and of the lane mixer; any odd values would do.
_M1, _M2, _M3 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def release() -> None:
    """Hand memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`run` for mapInArrow, whose worker gives up what it freed at the end of each partition; idle workers stay beside later stages."""

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return through


def byte_table(*spans: tuple[int, int]) -> np.ndarray:
    """256 flags, true for the bytes inside any of the inclusive spans."""
    table = np.zeros(256, bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


#: Words `[^\x20\x09-\x0D]+`.
NON_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`; applied after lower-casing.
ALNUM = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null counts as an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]), offsets - offsets[0]


def blocks(batch: pa.RecordBatch, name: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch cut between rows so that each piece holds about `most` bytes of text; one longer row stands alone."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(name))
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


class Words:
    """The words of a batch: byte starts, lengths and row of each, and `first[i]`, the index of row i's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool):
        self.data = LOWER[data] if lower else data
        mask = table[self.data]
        n = len(mask)
        if n:
            edge = np.zeros(n + 1, bool)
            edge[offsets] = True
            before = np.empty(n, bool)
            before[0], before[1:] = False, mask[:-1]
            starts = np.flatnonzero(mask & (~before | edge[:n]))
            after = np.empty(n, bool)
            after[-1], after[:-1] = False, mask[1:]
            ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
        else:
            starts = ends = np.zeros(0, np.int64)
        self.offsets, self.starts, self.lens = offsets, starts, ends - starts
        self.first = np.searchsorted(starts, offsets)
        self.counts = np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.lens)


def fmix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def hash_spans(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, 8 bytes a step; spans of equal bytes get equal hashes in any batch."""
    out = fmix(lens.astype(U64) + _M3)
    if not len(starts):
        return out
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    live, k = np.arange(len(starts)), 0
    while len(live):
        left = lens[live] - k
        lane = lanes[starts[live] + k]
        short = left < 8
        lane[short] &= (U64(1) << (left[short].astype(U64) * U64(8))) - U64(1)
        mixed = (out[live] ^ lane) * _M3
        mixed ^= mixed >> U64(29)
        out[live] = mixed * _M1
        k += 8
        live = live[left > 8]
    return fmix(out)


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of two hashes."""
    return fmix(left * _M2 + (right ^ _M3))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive hashes; one for each start that has n; the caller drops those that cross rows."""
    if len(hashes) < n:
        return np.zeros(0, U64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = pair_hash(out, hashes[k : len(hashes) - n + 1 + k])
    return out
