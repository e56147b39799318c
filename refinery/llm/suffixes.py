"""Removal of byte strings that occur earlier, by a partitioned sparse suffix array.

Suffixes. Of the k-byte grams in a window of ``LENGTH`` bytes the one of least rank
begins the window's suffix (the leftmost of equals). The choice depends on the window's
bytes alone, so equal windows have equal suffixes at the same distance from their start;
about one byte in 43 begins a suffix. The rank is a hash, after a flag for grams that are
frequent in a sample: a window that holds anything rare is sorted by it, and a passage
found in a third of all documents draws no other windows than its own. Suffixes whose
gram occurs once (by a table of counters over all texts) hold no repeat and are left out.

Buckets. Splitters, sampled suffixes at even ranks, cut the order of suffixes into
ranges. A window belongs to the range of its suffix' bytes inside the window; a suffix
that begins like a splitter may have windows that end before the two differ, which belong
to an earlier range: these are sent there also, which compares across the boundary.
Beyond ``MAX_SPLITTERS`` ranges, a range is handled in parts by a hash of the gram.

Sorting. A bucket sorts its suffixes by multikey quicksort, eight bytes a key, and the
bytes before them, reversed, likewise. Neighbours' common prefixes give each suffix its
class at every length. Two windows that start ``d`` bytes before their suffix are equal if
the suffixes agree in ``LENGTH - d`` bytes and what comes before in ``d``: those
two classes are the window's key, and all but the earliest place of a key are repeats.
No fingerprints: bytes are compared. A task first does the same to each slice of text and
sends a window once, from its first place there, so copies are collapsed map-side.

Nulls and ties: a null text has no bytes. A null doc_id counts as larger than any other.
Rows that share a doc_id and the text are the same place and do not repeat each other;
rows that share a doc_id only are compared by start, and at equal starts neither repeats
the other. Texts of any length are handled whole. Empty tables give empty results; extra
columns are kept in ``rest`` by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refinery.llm.sketch import frequent, reached, slots_for
from refinery.llm.store import in_tasks
from refinery.llm.textbatch import mix, pieces, ragged, utf8

LENGTH, GRAM = 100, 16
NO_ID = (1 << 63) - 1
SLICE_BYTES = 2 << 20
#: Text bytes behind a bucket, splitters at most.
BUCKET_BYTES, MAX_SPLITTERS = 8 << 20, 1 << 14
#: The sample: pieces of texts, of so many characters each, drawn in proportion to length. Grams in
#: at least this share of the pieces (and in 3) rank last; of these the most frequent, up to a number.
SAMPLE_PIECES, PIECE_CHARS, HOT_SHARE, HOT_GRAMS = 1024, 4096, 0.004, 1 << 16
_M = np.uint64(0x9E3779B97F4A7C15)
_LATE = np.uint64(1 << 63)


# --- Suffixes ----------------------------------------------------------------------

class Grams:
    """Rank of every k-byte gram, given the frequent ones (sorted hashes)."""

    def __init__(self, hot: np.ndarray):
        self.hot = hot
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(hot)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h & np.uint64((1 << 20) - 1)).astype(np.int64)

    @staticmethod
    def hashes(data: np.ndarray, gram: int) -> np.ndarray:
        """Of the ``gram`` bytes from each place on."""
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        at8 = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
        n = max(len(data) - gram + 1, 0)
        h = np.zeros(n, np.uint64)
        for k in range(0, gram, 8):
            word = at8[k:k + n]
            if gram - k < 8:
                word = word & np.uint64((1 << (8 * (gram - k))) - 1)
            h ^= word
            h *= _M
            h ^= h >> np.uint64(29)
        return mix(h)

    def ranks(self, h: np.ndarray) -> np.ndarray:
        out = h >> np.uint64(1)
        if len(self.hot):
            at = np.flatnonzero(self.maybe[self._slot(h)])
            at = at[np.isin(h[at], self.hot)]
            out[at] |= _LATE
        return out


class Seeds:
    """Suffixes of a slice: place ``at``, and windows that start ``dlo`` to ``dhi`` bytes before it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, grams: Grams, length: int, gram: int):
        self.data, self.offsets, self.length = data, offsets, length
        h = grams.hashes(data, gram)
        size = np.maximum(np.diff(offsets) - length + 1, 0)
        starts = ragged(offsets[:-1], size)
        if not len(starts):
            self.at = self.dlo = self.dhi = self.row = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        least = (grams.ranks(h) >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        width, held = length - gram + 1, 1
        while held * 2 <= width:
            least = np.minimum(least[:len(least) - held], least[held:])
            held *= 2
        if width > held:
            least = np.minimum(least[:len(least) - (width - held)], least[width - held:])
        at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(starts) != 1) | (at[1:] != at[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(starts)) - 1
        self.at = at[head]
        self.dhi, self.dlo = self.at - starts[head], self.at - starts[tail]
        self.hash = h[self.at]
        self.row = np.searchsorted(offsets, self.at, "right") - 1

    def take(self, pick: np.ndarray) -> "Seeds":
        out = object.__new__(Seeds)
        out.data, out.offsets, out.length = self.data, self.offsets, self.length
        for c in ("at", "dlo", "dhi", "hash", "row"):
            setattr(out, c, getattr(self, c)[pick])
        return out

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        return sides(self.data, self.at, self.dlo, self.dhi, self.length)


def _padded_width(length: int) -> int:
    return -(-length // 8) * 8


def sides(data: np.ndarray, at: np.ndarray, dlo: np.ndarray, dhi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes from ``at`` on, and those before it reversed, as far as windows reach, then zeros."""
    width = _padded_width(length)
    zeros = np.zeros(width, np.uint8)
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate([zeros, data, zeros]), width)
    k = np.arange(width)
    right = np.where(k < (length - dlo)[:, None], around[at + width], 0)
    left = np.where(k < dhi[:, None], around[at][:, ::-1], 0)
    return right, left


# --- Sorting -----------------------------------------------------------------------

def multikey_order(words: np.ndarray) -> np.ndarray:
    """Stable order of the rows of ``words`` by multikey quicksort: each segment is split in three by
    a pivot's key at the segment's depth; the middle part goes on one key deeper. All
    segments of a round are split together."""
    n, depth_end = words.shape
    order = np.arange(n)
    start, size, depth = np.array([0]), np.array([n]), np.array([0])
    while True:
        going = (size > 1) & (depth < depth_end)
        start, size, depth = start[going], size[going], depth[going]
        if not len(start):
            return order
        seg = np.repeat(np.arange(len(start)), size)
        place = ragged(start, size)
        rows = order[place]
        x = words[rows, depth[seg]]
        edge = np.cumsum(size) - size
        three = np.sort(np.stack([x[edge], x[edge + size // 2], x[edge + size - 1]]), axis=0)
        pivot = three[1][seg]
        kind = (x >= pivot).astype(np.int64) + (x > pivot)
        counts = np.bincount(seg * 3 + kind, minlength=3 * len(start)).reshape(-1, 3)
        offset = np.cumsum(counts, axis=1) - counts
        to = np.empty(len(place), np.int64)
        for c in range(3):
            mine = kind == c
            before = np.cumsum(mine) - mine
            to[mine] = (before - before[edge][seg])[mine]
        to += offset[seg, kind] + start[seg]
        order[to] = rows
        start = (start[:, None] + offset).ravel()
        size = counts.ravel()
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()


class Classes:
    """Strings (rows of bytes) sorted; ``at(n)`` numbers each string's class by its first n bytes."""

    def __init__(self, strings: np.ndarray):
        n, width = strings.shape
        words = np.ascontiguousarray(strings).view(">u8").astype(np.uint64)
        self.order = multikey_order(words)
        self.common = np.zeros(n + 1, np.int64)  # with the one before; none at both ends
        differ = words[self.order[1:]] != words[self.order[:-1]]
        first = np.where(differ.any(1), differ.argmax(1), width // 8 - 1)
        a, b = (words[o, first] for o in (self.order[1:], self.order[:-1]))
        bits = (a ^ b).reshape(-1, 1).view(np.uint8).reshape(-1, 8)[:, ::-1] != 0
        self.common[1:n] = first * 8 + np.where(bits.any(1), bits.argmax(1), 8)
        self.shared = np.empty(n, np.int64)
        self.shared[self.order] = np.maximum(self.common[:-1], self.common[1:])

    def at(self, n: int) -> np.ndarray:
        count = len(self.order)
        head = np.maximum.accumulate(np.where(self.common[:-1] < n, np.arange(count), 0))
        out = np.empty(count, np.int64)
        out[self.order] = head
        return out


def repeated(right: np.ndarray, left: np.ndarray, dlo: np.ndarray, dhi: np.ndarray, doc: np.ndarray, at: np.ndarray,
             length: int) -> np.ndarray:
    """Per suffix, and distance d of a window's start before it: whether the window occurs at an
    earlier place (smaller ``doc``, or same and smaller ``at``). Rows are sorted by place."""
    n = len(at)
    out = np.zeros((n, int(dhi.max(initial=-1)) + 1), bool)
    if n < 2:
        return out
    forward, back = Classes(right), Classes(left)
    for d in range(out.shape[1]):
        mine = np.flatnonzero((dlo <= d) & (d <= dhi) & (forward.shared >= length - d) & (back.shared >= d))
        if len(mine) < 2:
            continue
        key = forward.at(length - d)[mine] * n + back.at(d)[mine]
        order = np.argsort(key, kind="stable")
        new = np.ones(len(mine), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        head = mine[order[np.flatnonzero(new)]][np.cumsum(new) - 1]
        mine = mine[order]
        out[mine, d] = (doc[mine] != doc[head]) | (at[mine] != at[head])
    return out


# --- Tasks -------------------------------------------------------------------------

_PACKED = ("doc", "th", "at", "dlo", "dhi", "text")
_DDL = "part int, " + ", ".join(f"{c} binary" for c in _PACKED)
_RANGES = "doc_id long, th long, lo array<int>, hi array<int>"


def _pack(a: np.ndarray) -> bytes:
    """Byte planes (high bytes are alike), compressed."""
    planes = np.ascontiguousarray(a.reshape(-1, 1).view(np.uint8).reshape(len(a), -1).T) if len(a) else a
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _hash_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    return np.array([zlib.crc32(raw[a:b]) for a, b in zip(offsets, offsets[1:])], np.int64)


def _stretches(doc: np.ndarray, th: np.ndarray, start: np.ndarray, length: int) -> pa.RecordBatch:
    """Windows merged into maximal ranges, a row per document."""
    order = np.lexsort((start, th, doc))
    doc, th, start = doc[order], th[order], start[order]
    other = np.ones(len(doc), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
    new = other.copy()
    new[1:] |= start[1:] > start[:-1] + length
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(doc)) - 1
    rows = np.flatnonzero(other)
    edge = pa.array(np.append(np.searchsorted(head, rows), len(head)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(edge, pa.array(v.astype(np.int32))) for v in (start[head], start[tail] + length)]
    return pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(th[rows]), *lists], names=["doc_id", "th", "lo", "hi"])


def _homes(right: np.ndarray, dlo: np.ndarray, dhi: np.ndarray, splitters: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(suffix, bucket, dlo, dhi): where windows belong, by the suffix' bytes within them."""
    def bucket(some: np.ndarray, reach: np.ndarray) -> np.ndarray:
        cut = np.where(np.arange(some.shape[1]) < reach[:, None], some, 0).astype(np.uint8)
        return np.searchsorted(splitters, cut.view(f"S{some.shape[1]}").ravel(), "right")
    which = np.arange(len(dlo))
    if not len(splitters) or not len(which):
        return which, np.zeros(len(which), np.int64), dlo, dhi
    first, last = bucket(right, length - dhi), bucket(right, length - dlo)
    one = first == last
    parts = [(which[one], first[one], dlo[one], dhi[one])]
    across = which[~one]
    for k in range(0, len(across), 4096):
        some = across[k:k + 4096]
        size = dhi[some] - dlo[some] + 1
        each = np.repeat(some, size)
        d = ragged(dlo[some], size)
        home = bucket(right[each], length - d)
        new = np.ones(len(each), bool)
        new[1:] = (each[1:] != each[:-1]) | (home[1:] != home[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(each)) - 1
        parts.append((each[head], home[head], d[head], d[tail]))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _anchors(grams: Grams, length: int, gram: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in pieces(batches, "text", SLICE_BYTES):
            yield Seeds(*utf8(batch.column("text")), grams, length, gram).hash
    return found


def _send(grams: Grams, bits: bytes, splitters: np.ndarray, subs: int, length: int, gram: int):
    """Packed suffixes by bucket, and the repeats within each slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.frombuffer(bits, np.uint8)
        for batch in pieces(batches, "text", SLICE_BYTES):
            data, offsets = utf8(batch.column("text"))
            seeds = Seeds(data, offsets, grams, length, gram)
            seeds = seeds.take(np.flatnonzero(reached(often, seeds.hash)))
            if not len(seeds.at):
                continue
            doc = batch.column("doc_id").to_numpy()
            th = _hash_rows(data, offsets)
            seeds = seeds.take(np.lexsort((seeds.at - offsets[seeds.row], doc[seeds.row])))
            _, group, count = np.unique(seeds.hash, return_inverse=True, return_counts=True)
            own = np.flatnonzero(count[group] > 1)
            if len(own) > 1:
                some = seeds.take(own)
                place = some.at - offsets[some.row]
                again = repeated(*some.sides(), some.dlo, some.dhi, doc[some.row], place, length)
                i, d = np.nonzero(again)
                if len(i):
                    yield _packed_ranges(doc[some.row][i], th[some.row][i], place[i] - d, length)
                k = np.arange(again.shape[1])
                fresh = ~again & (k >= some.dlo[:, None]) & (k <= some.dhi[:, None])
                left = fresh.any(1)
                seeds.dlo[own] = np.where(left, fresh.argmax(1), 1)
                seeds.dhi[own] = np.where(left, again.shape[1] - 1 - fresh[:, ::-1].argmax(1), 0)
                seeds = seeds.take(np.flatnonzero(seeds.dlo <= seeds.dhi))
            right, _ = seeds.sides()
            which, home, dlo, dhi = _homes(right, seeds.dlo, seeds.dhi, splitters, length)
            del right
            part = home * subs + (seeds.hash[which] % np.uint64(subs)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            which, part, dlo, dhi = which[order], part[order], dlo[order], dhi[order]
            for a, b in _runs(part):
                s, lo, hi = which[a:b], dlo[a:b], dhi[a:b]
                at, row = seeds.at[s], seeds.row[s]
                text = data[ragged(at - hi, length + hi - lo)]
                blobs = [_pack(doc[row]), _pack(th[row].astype(np.uint32)), _pack((at - offsets[row]).astype(np.uint32)),
                         _pack(lo.astype(np.uint8)), _pack(hi.astype(np.uint8)),
                         zstandard.ZstdCompressor(level=3).compress(text.tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array([part[a]], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)],
                                                 names=["part", *_PACKED])
    return run


def _runs(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    head = np.flatnonzero(np.diff(sorted_keys, prepend=-1))
    return list(zip(head, np.append(head[1:], len(sorted_keys))))


def _packed_ranges(doc, th, start, length: int) -> pa.RecordBatch:
    """Repeats of a slice as a row of part -1."""
    ranges = _stretches(doc, th, start, length)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ranges.schema) as out:
        out.write_batch(ranges)
    blobs = [b"", b"", b"", b"", b"", sink.getvalue().to_pybytes()]
    return pa.RecordBatch.from_arrays([pa.array([-1 - len(blobs[-1]) % 1009], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)],
                                      names=["part", *_PACKED])


def _sorted_buckets(length: int, gram: int):
    """Rows sorted by part: the repeats in each bucket, as ranges."""
    def compare(held: list[dict]) -> Iterator[pa.RecordBatch]:
        doc, th, at, dlo, dhi = (np.concatenate([_unpack(r[c], k) for r in held]).astype(np.int64) for c, k in (
            ("doc", np.int64), ("th", np.uint32), ("at", np.uint32), ("dlo", np.uint8), ("dhi", np.uint8)))
        unpack = zstandard.ZstdDecompressor()
        data = np.frombuffer(b"".join(unpack.decompress(r["text"]) for r in held), np.uint8)
        held.clear()
        size = length + dhi - dlo
        begin = np.cumsum(size) - size + dhi  # the suffix in ``data``
        # Only grams that two places share need sorting.
        first = np.lib.stride_tricks.sliding_window_view(data, gram)[begin].ravel()
        _, group, count = np.unique(Grams.hashes(first, gram)[::gram], return_inverse=True, return_counts=True)
        del first
        pick = np.flatnonzero(count[group] > 1)
        pick = pick[np.lexsort((at[pick], doc[pick]))]
        if len(pick) < 2:
            return
        again = repeated(*sides(data, begin[pick], dlo[pick], dhi[pick], length), dlo[pick], dhi[pick], doc[pick], at[pick], length)
        i, d = np.nonzero(again)
        if len(i):
            yield _stretches(doc[pick][i], th[pick][i], at[pick][i] - d, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in ("part", *_PACKED)}
                if r["part"] < 0:
                    yield from pa.ipc.open_stream(r["text"])
                    continue
                if held and held[0]["part"] != r["part"]:
                    yield from compare(held)
                    held = []
                held.append(r)
        if held:
            yield from compare(held)
    return run


# --- The operator --------------------------------------------------------------------

def _sampled(texts: DataFrame, total: int, seed: int = 12) -> list[bytes]:
    """Pieces of texts, drawn in proportion to their length."""
    draw = (F.xxhash64("doc_id", F.octet_length("text"), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52))
    start = F.pmod(F.xxhash64(F.octet_length("text"), "doc_id", F.lit(seed + 1)), F.char_length("text")).cast("int") + 1
    rows = texts.where(F.octet_length("text") > 0).where(draw < F.octet_length("text") * (SAMPLE_PIECES / max(total, 1))) \
        .select(F.substring(F.col("text"), start, F.lit(PIECE_CHARS)).alias("text"))
    return [r.text.encode() for r in rows.limit(4 * SAMPLE_PIECES).collect()]


def _model(texts: DataFrame, length: int, gram: int, bucket_bytes: int) -> tuple[Grams, np.ndarray, int, int]:
    """Ranks, splitters, parts of a range, and slots of the counters."""
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sample = _sampled(texts, total)
    parts = -(-total // bucket_bytes) or 1
    data = np.frombuffer(b"".join(sample), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in sample])]).astype(np.int64)
    # Grams by the number of sampled pieces that hold them.
    held = [np.unique(Grams.hashes(data[a:b], gram)) for a, b in zip(offsets, offsets[1:])]
    each, count = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
    often = np.flatnonzero(count >= max(3, HOT_SHARE * len(sample)))
    often = often[np.argsort(-count[often], kind="stable")[:HOT_GRAMS]]
    grams = Grams(np.sort(each[often]))
    seeds = Seeds(data, offsets, grams, length, gram)
    ranges = min(parts, MAX_SPLITTERS)
    splitters = np.zeros(0, f"S{_padded_width(length)}")
    if ranges > 1 and len(seeds.at):
        right = np.sort(np.ascontiguousarray(seeds.sides()[0].astype(np.uint8)).view(f"S{_padded_width(length)}").ravel())
        splitters = np.unique(right[np.arange(1, ranges) * len(right) // ranges])
    return grams, splitters, -(-parts // ranges), slots_for(total // 16)


def repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (CRC-32 of the text), ranges lo, hi of bytes to remove, as arrays, possibly
    overlapping; a row per document that has any."""
    texts = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    grams, splitters, subs, slots = _model(texts, length, gram, bucket_bytes)
    bits = frequent(texts, _anchors(grams, length, gram), slots, 2)
    sent = in_tasks(texts, _send(grams, bits, splitters, subs, length, gram), _DDL)
    buckets = max((len(splitters) + 1) * subs, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = in_tasks(sent.repartition(buckets, "part").sortWithinPartitions("part"), _sorted_buckets(length, gram), _RANGES)
    return found.groupBy("doc_id", "th").agg(
        F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", SLICE_BYTES):
        data, offsets = utf8(batch.column("text"))
        edge = np.zeros(len(data) + 1, np.int64)
        los, his = batch.column("lo"), batch.column("hi")
        for i in np.flatnonzero(np.asarray(los.is_valid())):
            np.add.at(edge, offsets[i] + los[i].values.to_numpy(), 1)
            np.add.at(edge, offsets[i] + his[i].values.to_numpy(), -1)
        keep = np.cumsum(edge)[:-1] == 0
        gone = np.concatenate([[0], np.cumsum(~keep)])[offsets]
        before = np.concatenate([[True], keep[:-1]])
        before[offsets[:-1][offsets[:-1] < len(keep)]] = True
        spans = np.concatenate([[0], np.cumsum(~keep & before)])[offsets]
        kept = data[keep]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("rest"), pa.array(np.diff(offsets)), pa.array(np.diff(gone)),
             pa.array(np.diff(spans)),
             pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows,
                                              [None, pa.py_buffer((offsets - gone).astype(np.int64)), pa.py_buffer(kept)]).cast(pa.binary())],
            names=["doc_id", "rest", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, rest (a struct of all columns but the text), n_bytes, n_removed,
    n_spans and kept (binary: the bytes that stay)."""
    found = repeats(docs, length=length, gram=gram, bucket_bytes=bucket_bytes, id_col=id_col, text_col=text_col)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"), rest.alias("rest")) \
        .withColumn("key", F.coalesce("doc_id", F.lit(NO_ID))) \
        .withColumn("th", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    joined = rows.join(found.withColumnRenamed("doc_id", "key"), ["key", "th"], "left") \
        .select("doc_id", "text", "rest", "lo", "hi")
    schema = joined.select("doc_id", "rest").schema.add("n_bytes", "long").add("n_removed", "long") \
        .add("n_spans", "long").add("kept", "binary")
    return in_tasks(joined, _cut, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the sha-256 of what stays."""
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """The contract byte by byte, for tests."""
    first: dict[bytes, tuple] = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        i = NO_ID if i is None else i
        for s in range(len(b) - length + 1):
            k = b[s:s + length]
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - length + 1):
            if first[b[s:s + length]] < (NO_ID if i is None else i, s):
                gone[s:s + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out
