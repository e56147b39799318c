"""Removal of repeated word sequences by seed and extend.

Seeds are winnowed anchors: of the k-word grams in each window of ``LENGTH``
words the one with the smallest hash (the leftmost of equals). The choice depends
on the window's words alone, so equal windows choose the same anchor at the same
place; joining occurrences on the anchor therefore brings together all places of
every repeated window. Around a seed, the windows that chose it are neighbours:
they are its extensions to both sides, each held by a fingerprint of its words.
Within an anchor's group a window is a repeat if its fingerprint occurs at an
earlier place (smaller doc_id, or same document and earlier start); adjoining
repeats merge into maximal repeated stretches, and these words are removed.

The work is linear in the number of windows: groups are compared by sorting, not
by pairs. A task sends a window once, from its first place there; later places of
the same task are repeats without further ado. So an anchor that fills a third of
the input sends one row's worth from each slice of text. Seeds travel packed by
hash part.

Windows are judged on the input as a whole, by 64-bit anchors and 48-bit
fingerprints within an anchor's group (together a 112-bit key).

Nulls and ties: a null text has no words (n_words 0, kept text empty). A null
doc_id counts as larger than any other. Rows that share a doc_id and the text are
the same place and do not repeat each other; rows that share a doc_id only are
compared by start, and at equal starts neither repeats the other. Texts of any
length are handled whole. Empty tables give empty results; extra columns are
ignored by ``repeats`` and kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refinery.llm.store import in_tasks
from refinery.llm.textbatch import Words, inner, ngrams, pieces, ragged

LENGTH, GRAM = 20, 6
SLICE_BYTES = 4 << 20
NO_ID = (1 << 63) - 1
_FP = 6  # bytes of a window's fingerprint


def anchors(h: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For word hashes ``h`` of documents with word ranges ``bounds``: starts of all
    windows, the position of the anchor each chose, and the grams' hashes."""
    starts = inner(bounds, length)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64)
    grams = ngrams(h, gram)
    low = max(1, int(len(grams)).bit_length())
    keyed = (grams >> np.uint64(low) << np.uint64(low)) | np.arange(len(grams), dtype=np.uint64)
    width, least = length - gram + 1, keyed
    size = 1
    while size * 2 <= width:  # least over `size` grams, doubled
        least = np.minimum(least[:len(least) - size], least[size:])
        size *= 2
    rest = width - size
    if rest:
        least = np.minimum(least[:len(least) - rest], least[rest:])
    at = (least[starts] & np.uint64((1 << low) - 1)).astype(np.int64)
    return starts, at, grams


def _first_places(key: np.ndarray, fp: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """True for each window (anchor key, fingerprint, document order, start) that is
    an earliest place of its sequence."""
    order = np.lexsort((start, doc, fp, key))
    k, f, d, s = key[order], fp[order], doc[order], start[order]
    same = np.zeros(len(k), bool)
    same[1:] = (k[1:] == k[:-1]) & (f[1:] == f[:-1])
    group = np.cumsum(~same) - 1
    head = np.flatnonzero(~same)
    out = np.empty(len(k), bool)
    out[order] = (d == d[head][group]) & (s == s[head][group])
    return out


def _stretches(doc: np.ndarray, th: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Windows (document, text hash, start) merged into maximal word ranges."""
    order = np.lexsort((start, th, doc))
    doc, th, start = doc[order], th[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (start[1:] > start[:-1] + length)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(doc)) - 1
    return doc[head], th[head], start[head], start[tail] + length


def _pack(a: np.ndarray) -> bytes:
    """Byte planes (high bytes are alike), compressed."""
    planes = np.ascontiguousarray(a.reshape(-1, 1).view(np.uint8).reshape(len(a), -1).T) if len(a) else a
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(blob: bytes, kind, width: int | None = None) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    if width:
        return np.ascontiguousarray(raw.reshape(-1, width))
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


_DDL = "part int, kind tinyint, doc binary, th binary, start binary, anchor binary, n binary, fp binary"
_SCHEMA = pa.schema([("part", pa.int32()), ("kind", pa.int8())]
                    + [(c, pa.binary()) for c in ("doc", "th", "start", "anchor", "n", "fp")])
_RANGES = "doc_id long, th long, lo array<int>, hi array<int>"


def _text_hash(words: Words) -> np.ndarray:
    import zlib

    raw = words.data.tobytes()
    return np.array([zlib.crc32(raw[a:b]) for a, b in zip(words.offsets, words.offsets[1:])], np.uint32)


def _seeds(length: int, gram: int, parts: int):
    """One row per slice and hash part with the first places of the slice's windows
    (kind 0), and one with the slice's own repeats as ranges (kind 1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, batch in enumerate(pieces(batches, "text", SLICE_BYTES)):
            words = Words(batch.column("text"))
            h = words.hashes()
            starts, at, grams = anchors(h, words.bounds, length, gram)
            if not len(starts):
                continue
            fp = (ngrams(h, length)[starts] >> np.uint64(64 - 8 * _FP))
            row = words.doc[starts]
            doc = batch.column("doc_id").to_numpy()[row]
            th = _text_hash(words)[row]
            start = starts - words.bounds[row]
            anchor = grams[at]
            first = _first_places(anchor, fp, doc, start)
            rows = []
            if not first.all():
                d, t, lo, hi = _stretches(doc[~first], th[~first], start[~first], length)
                rows.append((n % parts, 1, _pack(d), _pack(t), _pack(lo.astype(np.int32)),
                             _pack(hi.astype(np.int32)), b"", b""))
            own = np.flatnonzero(first)
            # Runs of neighbouring first places that chose the same anchor: the seeds.
            new = np.ones(len(own), bool)
            new[1:] = (np.diff(own) != 1) | (at[own][1:] != at[own][:-1]) | (row[own][1:] != row[own][:-1])
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, len(own)))
            seed = own[head]
            part = (anchor[seed] % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((anchor[seed], part))
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            bytes_of = fp.reshape(-1, 1).view(np.uint8)[:, :_FP]
            for p in np.flatnonzero(np.diff(cuts)):
                mine = order[cuts[p]:cuts[p + 1]]
                s = seed[mine]
                prints = bytes_of[own[ragged(head[mine], count[mine])]]
                rows.append((int(p), 0, _pack(doc[s]), _pack(th[s]), _pack(start[s].astype(np.uint32)),
                             _pack(anchor[s]), _pack(count[mine].astype(np.uint8)),
                             zstandard.ZstdCompressor(level=1).compress(prints.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)],
                                             schema=_SCHEMA)
    return run


def _grouped(doc, th, lo, hi) -> pa.RecordBatch:
    """Ranges as one row per document."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
    head = np.flatnonzero(new)
    edge = pa.array(np.append(head, len(doc)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(edge, pa.array(v.astype(np.int32))) for v in (lo, hi)]
    return pa.RecordBatch.from_arrays([pa.array(doc[head]), pa.array(th[head].astype(np.int64)), *lists],
                                      names=["doc_id", "th", "lo", "hi"])


def _extend(length: int):
    """Rows sorted by part: anchors' groups compared, repeats out as ranges."""
    def compare(held: list[dict]) -> Iterator[pa.RecordBatch]:
        doc, th, start, anchor, n = (np.concatenate([_unpack(r[c], k) for r in held]) for c, k in (
            ("doc", np.int64), ("th", np.uint32), ("start", np.uint32), ("anchor", np.uint64), ("n", np.uint8)))
        prints = np.concatenate([_unpack(r["fp"], None, _FP) for r in held])
        n = n.astype(np.int64)
        order = np.argsort(anchor, kind="stable")
        same = anchor[order][1:] == anchor[order][:-1]
        shared = np.zeros(len(anchor), bool)
        shared[order[1:][same]] = True
        shared[order[:-1][same]] = True
        pick = np.flatnonzero(shared)
        if not len(pick):
            return
        fp = np.zeros((int(n[pick].sum()), 8), np.uint8)
        at = ragged((np.cumsum(n) - n)[pick], n[pick])
        fp[:, :_FP] = prints[at]
        del prints
        each = np.repeat(pick, n[pick])
        s = start[each].astype(np.int64) + (at - (np.cumsum(n) - n)[each])
        first = _first_places(anchor[each], fp.view(np.uint64).ravel(), doc[each], s)
        if not first.all():
            yield _grouped(*_stretches(doc[each][~first], th[each][~first], s[~first], length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 1:
                    yield _grouped(*(_unpack(r[c], k) for c, k in (
                        ("doc", np.int64), ("th", np.uint32), ("start", np.int32), ("anchor", np.int32))))
                    continue
                if held and held[0]["part"] != r["part"]:
                    yield from compare(held)
                    held = []
                held.append(r)
        if held:
            yield from compare(held)
    return run


def repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th (CRC-32 of the text), ranges lo, hi of word numbers to remove, as
    arrays, possibly overlapping; one row per document that has any."""
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"),
                        F.col(text_col).alias("text"))
    seeds = in_tasks(texts, _seeds(length, gram, parts), _DDL)
    found = in_tasks(seeds.repartition("part").sortWithinPartitions("part"), _extend(length), _RANGES)
    return found.groupBy("doc_id", "th").agg(
        F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi"))


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """(words, words removed, kept words joined by one space) of each row."""
    words = Words(batch.column("text"))
    removed = np.zeros(len(words) + 1, np.int64)
    los, his = batch.column("lo"), batch.column("hi")
    counts = np.diff(words.bounds)
    for i in np.flatnonzero(np.asarray(los.is_valid())):
        lo, hi = los[i].values.to_numpy(), his[i].values.to_numpy()
        np.add.at(removed, words.bounds[i] + lo, 1)
        np.add.at(removed, words.bounds[i] + hi, -1)
    keep = np.cumsum(removed)[:-1] == 0
    total = np.concatenate([[0], np.cumsum(keep)])[words.bounds]
    starts, size = words.starts[keep], (words.ends - words.starts)[keep]
    room = np.cumsum(size + 1) - (size + 1)  # each kept word and a space
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    out[ragged(room, size)] = words.data[ragged(starts, size)]
    inside = np.concatenate([[0], np.cumsum((words.ends - words.starts + 1) * keep)])[words.bounds]
    raw = out.tobytes()
    for i in range(batch.num_rows):
        yield int(counts[i]), int(counts[i] - (total[i + 1] - total[i])), raw[inside[i]:max(inside[i], inside[i + 1] - 1)]


def _apply(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = ["doc_id", "text", "rest"] if keep_text else ["doc_id", "rest"]
        for batch in pieces(batches, "text"):
            n, gone, kept = zip(*_cut(batch))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in same), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(kept, pa.binary())], names=[*same, "n_words", "n_removed", "kept"])
    return run


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM,
                   id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, text (if ``keep_text``), rest (a struct of all columns but the text),
    n_words, n_removed and kept (binary: UTF-8 words that stay, joined by a space)."""
    found = repeats(docs, length=length, gram=gram, id_col=id_col, text_col=text_col)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.struct(*others).alias("rest")) \
        .withColumn("key", F.coalesce("doc_id", F.lit(NO_ID))) \
        .withColumn("th", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    joined = rows.join(found.withColumnRenamed("doc_id", "key"), ["key", "th"], "left") \
        .select("doc_id", "text", "rest", "lo", "hi")
    schema = joined.select("doc_id", *["text"] * keep_text, "rest").schema
    for c in ("n_words", "n_removed"):
        schema = schema.add(c, "long")
    return in_tasks(joined, _apply(keep_text), schema.add("kept", "binary"))


def strip_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` (doc_id, text, n_chars and any others) less their repeated words. A text
    that loses no word stays as it is, white space included; one that loses some
    becomes its kept words joined by one space, with n_chars counted anew. Rows that
    lose every word go; rows without words stay."""
    out = remove_repeats(docs, length=length, gram=gram, keep_text=True).where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept").cast("string"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(text.alias("text"))
        elif c == "n_chars":
            kind = docs.schema["n_chars"].dataType
            columns.append(F.when(F.col("n_removed") == 0, F.col("rest.n_chars"))
                           .otherwise(F.char_length(F.col("kept").cast("string")).cast(kind)).alias("n_chars"))
        else:
            columns.append(F.col(f"rest.`{c}`").alias(c))
    return out.select(*columns)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the sha-256 of what stays."""
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The contract word by word, for tests."""
    import re

    split = [(i, re.findall("[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first: dict[tuple, tuple] = {}
    for i, w in split:
        for s in range(len(w) - length + 1):
            k = tuple(w[s:s + length])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, w in split:
        gone = {p for s in range(len(w) - length + 1) if first[tuple(w[s:s + length])] < (i, s)
                for p in range(s, s + length)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
