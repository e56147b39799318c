"""A table of small counters indexed by hash, summed over all tasks.

Tells which hashes certainly occur fewer than ``least`` times. The table has a fixed
number of slots, so what is broadcast has a fixed bound; a fuller table answers "maybe"
more often. Counters stop at ``least`` and travel packed by range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from refinery.llm.store import in_tasks

MIN_SLOTS, MAX_SLOTS, RANGE = 1 << 16, 1 << 27, 1 << 13


def slots_for(expected: int) -> int:
    """Power of two of at least ``expected`` slots, within the bounds."""
    return min(MAX_SLOTS, max(MIN_SLOTS, 1 << max(int(expected) - 1, 1).bit_length()))


def _counters(found: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], slots: int, least: int):
    """Rows (part, counts): ranges of what a task has counted, up to ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = np.zeros(slots, np.uint8), False
        for h in found(batches):
            at, n = np.unique(h & np.uint64(slots - 1), return_counts=True)
            at = at.astype(np.int64)
            held[at] = np.minimum(held[at] + n, least)
            seen = seen or len(at) > 0
        if not seen:
            return
        pack = zstandard.ZstdCompressor(level=1)
        rows = held.reshape(-1, min(slots, RANGE))
        full = np.flatnonzero(rows.any(1))
        for at in range(0, len(full), 512):
            some = full[at:at + 512]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array([pack.compress(rows[i].tobytes()) for i in some], pa.binary())],
                names=["part", "counts"])
    return run


def _merged(least: int):
    """Rows sorted by range: which counters reach ``least``, as bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None

        def done():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()),
                                               "bits": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for p, blob in zip(batch.column("part").to_pylist(), batch.column("counts")):
                counts = np.frombuffer(unpack.decompress(blob.as_py()), np.uint8)
                if p == part:
                    total = np.minimum(total.astype(np.uint16) + counts, least).astype(np.uint8)
                    continue
                if part is not None:
                    yield done()
                part, total = p, counts
        if part is not None:
            yield done()
    return run


def frequent(df: DataFrame, found: Callable, slots: int, least: int) -> bytes:
    """``slots`` bits: whether the hashes (uint64) of a slot, which ``found`` gives for a task's
    batches, occur ``least`` times together."""
    counts = in_tasks(df, _counters(found, slots, least), "part int, counts binary")
    bits = in_tasks(counts.repartition("part").sortWithinPartitions("part"), _merged(least), "part int, bits binary")
    out, width = bytearray(slots // 8), min(slots, RANGE) // 8
    for r in bits.collect():  # slots / 8 bytes at most
        out[r.part * width:(r.part + 1) * width] = r.bits
    return bytes(out)


def reached(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of hashes: whether they may occur often enough. ``bits``: ``frequent`` as uint8."""
    at = h & np.uint64(len(bits) * 8 - 1)
    return bits[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
