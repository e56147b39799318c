"""Vectorised word handling on Arrow string columns (used inside Spark tasks).

A batch's UTF-8 bytes are treated as one numpy array, so words of many documents
are found, hashed and combined into n-gram hashes without a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Word bytes of the contracts: everything but space and \x09-\x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits and all bytes of non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
_S = [np.uint64(s) for s in range(64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = (h ^ (h >> _S[30])) * _M2
    h = (h ^ (h >> _S[27])) * _M3
    return h ^ (h >> _S[31])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of ``column`` (one longer
    row stays whole), which bounds the size of the arrays made from a slice."""
    for batch in batches:
        _, offsets = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


class Words:
    """Words of a slice: byte positions, document of each, word range of each document."""

    def __init__(self, column: pa.Array, keep: np.ndarray = NOT_SPACE, lower: bool = False):
        data, self.offsets = utf8(column)
        self.data = LOWER[data] if lower else data
        n, docs = len(data), len(self.offsets) - 1
        inside = keep[data]
        before = np.empty(n, bool)
        before[1:] = inside[:-1]
        first = self.offsets[:-1]
        before[first[first < n]] = False
        after = np.empty(n, bool)
        after[:-1] = inside[1:]
        last = self.offsets[1:] - 1
        after[last[last >= 0]] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        #: word index at which each document begins; docs + 1 entries
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.doc = np.repeat(np.arange(docs), np.diff(self.bounds))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, eight bytes at a step."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        at8 = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        size = self.ends - self.starts
        h = (at8[self.starts] & _MASKS[np.minimum(size, 8)]) * _M1 ^ size.astype(np.uint64) * _M2
        h = mix(h)
        left, k = np.flatnonzero(size > 8), 8
        while len(left):
            v = at8[self.starts[left] + k] & _MASKS[np.minimum(size[left] - k, 8)]
            h[left] = mix(h[left] * _M1 + v)
            k += 8
            left = left[size[left] > k]
        return h


def powers(n: int) -> np.ndarray:
    """_BASE ** i mod 2**64 for i < n."""
    out = np.full(n, _BASE, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each word on (the last k - 1 entries are left
    out); windows over document borders are for the caller to leave out."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j, p in enumerate(powers(k)):
        out += h[j:len(h) - k + 1 + j] * p
    return mix(out)


def inner(bounds: np.ndarray, k: int) -> np.ndarray:
    """Starts of all windows of ``k`` words that lie within one document."""
    n = int(bounds[-1])
    ok = np.ones(n + 1, bool)
    for j in range(1, k):
        at = bounds[1:] - j
        ok[at[at >= bounds[:-1]]] = False
    ok = ok[:n]
    return np.flatnonzero(ok)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ranges(start, start + count)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
