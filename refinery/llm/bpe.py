"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Documents are cut into pre-tokens ("words") in blocks of bounded size. A block
keeps the position of every word as a number into the block's list of distinct
words; only the distinct words travel, dealt by their hash, so that all blocks'
copies of a word meet in one task, which merges it once. The ids go back to the
block, where documents are reassembled by position. Decoding joins ids with the
token-byte table, whose size is that of the vocabulary (broadcast).

A word goes once per block through the shuffle however often it occurs, so the
commonest word costs no more than a rare one. Words and ids travel packed: one
row holds what one block has for one hash part.

Nulls: a null text is encoded as an empty one (no ids); a null doc_id stays null.
Repeated rows and repeated doc_ids are encoded row by row. An empty table gives
an empty result. Columns other than the id and the text are ignored, so clashing
names in the input do no harm.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refinery.llm.store import in_tasks
from refinery.llm.textbatch import pieces, ragged, utf8

#: White space as the tokenizer's pattern has it (Unicode White_Space). Fixed values.
_WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Cuts a text where no pre-token can run across: before single spaces and around
#: runs of white space. Each piece is then matched by the real pattern, once.
_CUT = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
BLOCK_BYTES = 8 << 20
ROWS_OUT_BYTES = 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of lowest rank (the leftmost of
    equals) is merged until no adjacent pair is a token."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 200:
        return _merge_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    get, none = ranks.get, 1 << 62
    costs = [get(parts[i] + parts[i + 1], none) for i in range(len(parts) - 1)]
    while costs:
        low = min(costs)
        if low == none:
            break
        i = costs.index(low)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i:
            costs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(costs):
            costs[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over a linked list, n log n for very long pre-tokens."""
    import heapq

    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(word[i:end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue  # one of the two has been merged since
        j = end[i]
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i:end[i]]] for i in range(n) if alive[i]]


class _Numbers(dict):
    """Numbers new keys in the order of their first use."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _pack(*arrays: np.ndarray) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _varints(v: np.ndarray) -> np.ndarray:
    """1 to 5 bytes a number, low 7 bits first."""
    size = 1 + sum((v >= (1 << (7 * i))).astype(np.int64) for i in range(1, 5))
    out = np.zeros(int(size.sum()), np.uint8)
    at = np.cumsum(size) - size
    for i in range(5):
        more = size > i
        byte = (v[more] >> np.uint32(7 * i)) & np.uint32(127)
        out[at[more] + i] = byte | (np.uint32(128) * (size[more] > i + 1))
    return out


def _from_varints(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.uint32)
    size = last - first + 1
    for i in range(5):
        more = size > i
        out[more] |= (raw[first[more] + i].astype(np.uint32) & np.uint32(127)) << np.uint32(7 * i)
    return out


def _pack_numbers(v: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers: each one's low 7 bits and whether there are more, then the rest of
    those that have more. Bytes of one kind stand together, so they compress better."""
    more = v >= 128
    low = v.astype(np.uint8) & np.uint8(127) | more.astype(np.uint8) << np.uint8(7)
    return _pack(np.array([len(v)], np.int64), low, _varints(v[more].astype(np.uint32) >> np.uint32(7)))


def _unpack_numbers(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(_unpack(blob), np.uint8)
    low = raw[8:8 + int(raw[:8].view(np.int64)[0])]
    out = (low & np.uint8(127)).astype(np.uint32)
    out[low >= 128] |= _from_varints(raw[8 + len(low):]) << np.uint32(7)
    return out


#: kind 0: words of a block for one hash part; 1: a block's documents; 2: ids for a pack of words.
_ROW = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("kind", pa.int8()),
                  ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_ROW_DDL = "part int, block long, kind tinyint, n long, a binary, b binary, c binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)


class _Block:
    """Texts gathered until they fill a block."""

    def __init__(self):
        self.cut, self.at, self.ids, self.counts, self.bytes = _Numbers(), [], [], [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.ids += batch.column(0).to_pylist()
        number = self.cut.__getitem__
        for text in batch.column(1).to_pylist():
            found = _CUT.findall(text) if text else []
            self.at.append(np.fromiter(map(number, found), np.int32, len(found)))
            self.counts.append(len(found))
        self.bytes += len(utf8(batch.column(1))[0])

    def rows(self, block: int, pattern, parts: int) -> Iterator[tuple]:
        words = _Numbers()
        sub, size = [], np.empty(len(self.cut), np.int64)
        for i, piece in enumerate(self.cut):
            found = pattern.findall(piece)
            size[i] = len(found)
            sub.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
        self.cut = None
        sub = np.concatenate(sub) if sub else np.zeros(0, np.int32)
        cut_at = np.concatenate(self.at) if self.at else np.zeros(0, np.int32)
        self.at = None
        each = size[cut_at].astype(np.int32)
        seq = sub[ragged((np.cumsum(size) - size)[cut_at], each)]
        del sub, cut_at
        per_doc = np.add.reduceat(np.append(each, 0), np.cumsum([0, *self.counts[:-1]])) * (np.array(self.counts) > 0)
        del each
        rank = np.empty(len(words), np.int32)  # frequent words get small numbers
        order = np.argsort(-np.bincount(seq, minlength=len(words)), kind="stable")
        rank[order] = np.arange(len(words))
        raw = [w.encode() for w in words]
        del words
        part = np.fromiter((zlib.crc32(w) for w in raw), np.int64, len(raw)) % parts
        by_part = np.lexsort((rank, part))
        ends = np.searchsorted(part[by_part], np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(ends)):
            own = by_part[ends[p]:ends[p + 1]]
            mine = [raw[i] for i in own]
            ranks = rank[own]
            yield (int(p), block, 0, len(mine), _pack_numbers(np.fromiter(map(len, mine), np.uint32, len(mine))),
                   zstandard.ZstdCompressor(level=3).compress(b"".join(mine)),
                   _pack_numbers(np.diff(ranks, prepend=0).astype(np.uint32)))
        known = np.array([i is not None for i in self.ids], bool)
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        yield (block % parts, block, 1, len(ids), _pack(ids, known.astype(np.uint8)),
               _pack_numbers(per_doc.astype(np.uint32)), _pack_numbers(rank[seq].astype(np.uint32)))


def _split(pattern: str, parts: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = regex.compile(pattern)
        base, n, block = TaskContext.get().partitionId() << 32, 0, _Block()
        for batch in pieces(batches, "text", min(block_bytes, 1 << 20)):
            block.add(batch)
            if block.bytes >= block_bytes:
                yield from _bounded(block.rows(base + n, compiled, parts))
                n, block = n + 1, _Block()
        if block.ids:
            yield from _bounded(block.rows(base + n, compiled, parts))
    return run


def _bounded(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += sum(map(len, row[4:])) + 64
        if size >= ROWS_OUT_BYTES:
            yield _rows(kept)
            kept, size = [], 0
    if kept:
        yield _rows(kept)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: a batch's packs are not copied all at once."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _encode_words(ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known, part = ranks.value, {}, None  # known: words of the part at hand

        def reply(row: dict) -> tuple:
            nonlocal known, part
            if row["part"] != part:
                known, part = {}, row["part"]
            size = _unpack_numbers(row["a"])
            raw, at, found = _unpack(row["b"]), 0, []
            for s in size.tolist():
                w = raw[at:at + s]
                at += s
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = merge_word(w, table)
                found.append(ids)
            counts = np.fromiter(map(len, found), np.uint32, len(found))
            flat = np.array([i for ids in found for i in ids], np.uint32)
            return row["part"], row["block"], 2, row["n"], _pack_numbers(counts), _pack_numbers(flat), row["c"]

        yield from _bounded(tuple(r[f.name] for f in _ROW) if r["kind"] == 1 else reply(r) for r in _each(batches))
    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, kind): a block's documents, then its packs of ids."""
    held: list[dict] = []
    for row in _each(batches):
        if held and row["block"] != held[0]["block"]:
            yield from _documents(held)
            held = []
        held.append(row)
    if held:
        yield from _documents(held)


def _documents(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    docs, packs = rows[0], rows[1:]
    n, n_words = docs["n"], sum(p["n"] for p in packs)
    counts = np.zeros(n_words, np.int64)
    own, flat = [], []
    for p in packs:
        at = np.cumsum(_unpack_numbers(p["c"]).astype(np.int64))
        counts[at] = _unpack_numbers(p["a"])
        own.append(at)
        flat.append(_unpack_numbers(p["b"]))
    starts = np.cumsum(counts) - counts
    table = np.zeros(int(counts.sum()), np.uint32)
    for at, ids in zip(own, flat):
        table[ragged(starts[at], counts[at])] = ids
    head = _unpack(docs["a"])
    doc_ids, known = np.frombuffer(head[:8 * n], np.int64), np.frombuffer(head[8 * n:], np.uint8).astype(bool)
    per_doc = _unpack_numbers(docs["b"]).astype(np.int64)
    seq = _unpack_numbers(docs["c"]).astype(np.int64)
    ends = np.cumsum(per_doc)
    at = 0
    while at < n:  # about ROWS_OUT_BYTES of words at a time
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (ROWS_OUT_BYTES >> 4), "right")))
        lo, hi = (int(ends[at - 1]) if at else 0), int(ends[stop - 1])
        words = seq[lo:hi]
        each = counts[words]
        ids = table[ragged(starts[words], each)]
        edge = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], ends[at:stop] - lo])]
        data = pa.py_buffer(ids.tobytes())
        binary = pa.Array.from_buffers(pa.binary(), stop - at, [None, pa.py_buffer((edge * 4).astype(np.int32)), data])
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc_ids[at:stop], mask=~known[at:stop]), pa.array(np.diff(edge)), binary],
            names=["doc_id", "n_tokens", "ids"])
        at = stop


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id long, n_tokens long, ids binary (little-endian unsigned 32-bit
    numbers) for every row of ``docs``. ``ranks_path`` is read on the driver and
    its table (bounded by the vocabulary) broadcast."""
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    split = in_tasks(texts, _split(pattern, parts, block_bytes), _ROW_DDL)
    replies = in_tasks(split.repartition("part").sortWithinPartitions("part"), _encode_words(ranks), _ROW_DDL)
    return in_tasks(replies.repartition("block").sortWithinPartitions("block", "kind"),
                    _assemble, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` (with a binary column ids) plus ``decoded`` binary: the ids
    joined with the broadcast token-byte table, in order. Null ids decode to null."""
    by_id = {i: b for b, i in read_ranks(ranks_path).items()}
    table = encoded.sparkSession.sparkContext.broadcast([by_id.get(i, b"") for i in range(max(by_id) + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = table.value.__getitem__
        for batch in pieces(batches, "ids", ROWS_OUT_BYTES):
            out = [b"".join(map(get, np.frombuffer(v.as_buffer(), "<u4").tolist())) if v.is_valid else None
                   for v in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())],
                                             names=[*batch.schema.names, "decoded"])

    return in_tasks(encoded, run, T.StructType(list(encoded.schema)).add("decoded", T.BinaryType()))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, sha-256 of the ids and of the decoded bytes."""
    return decode(encode(docs, ranks_path, pattern), ranks_path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary) and decoded (binary) of every row."""
    return decode(encode(docs, ranks_path, pattern), ranks_path)


def tokenizer(spark: SparkSession) -> tuple[str, str]:
    """Path of the ranks and the pattern: ``spark.refinery.bpe.ranks`` if set,
    else the public multilingual vocabulary."""
    import public_tokenizers

    own = spark.conf.get("spark.refinery.bpe.ranks", None)
    return own or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
