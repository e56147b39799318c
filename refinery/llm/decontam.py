"""Benchmark decontamination by latent semantic retrieval.

1. Documents are cut into overlapping passages of ``2 * HALF`` words (every
   ``HALF``); benchmark items likewise. Terms are the items' words; the distinct
   places of each are counted over the whole corpus.
2. A randomised SVD of the passages' TF-IDF matrix: every task adds its passages'
   part of A'A.Omega (terms x rank; from the pairs of each passage's terms while A'A is no
   larger than ``GRAM``, else from its rows of Omega), Spark sums the parts, and the driver gets the
   right singular vectors from the small sums. All passages of all texts are fitted on,
   ``SKETCH`` at a time. The items' own passages are rows of A too, and the rank exceeds
   their number, so their directions are kept.
3. Passages are projected and compared with the items' projections; pairs with a
   cosine of at least ``COSINE`` are candidates.
4. Each candidate with enough of the item's words is checked on them: the longest common subsequence of the item
   and the text around the passage, as a share of the item, and that of the answer
   (the item's last sentence). A pair leaks if the first is ``SHARE`` or more, or
   ``LOOSE`` or more with ``ANSWER`` of the answer: a paraphrase that keeps it.

Items are taken in blocks of ``ITEMS``, each with a walk over the corpus, so the
driver and the broadcast hold a block's terms and vectors, whatever the number of
items. A term's weight is log(1 + (passages + PRIOR) / (uses + 1)): every term weighs
something, as a paraphrase may keep an item's common words only. ``uses`` counts the
distinct places of a term (with the words beside it), so copies of an item, wherever
they stand, count once; a sketch of ``REGISTERS`` bytes a term estimates it.

Nulls and ties: null or wordless texts and items match nothing. Rows that share a
doc_id or an item_id are merged in the result (best pair). A null doc_id or item_id
is kept as null. Long texts are walked whole. Empty tables give empty results;
extra columns are ignored by ``leaks`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refinery.llm.store import in_tasks, saved
from refinery.llm.textbatch import ALNUM, Words, pieces

HALF, ITEMS, EXTRA_RANK = 24, 256, 32
PRIOR, REGISTERS = 1000.0, 128
SKETCH = 4096  # passages that a task adds to the fit at a time
GRAM = 1 << 25  # numbers of A'A that a task may hold (128 MB); wider vocabularies go by rows of Omega
OFTEN = 64  # a term of one passage in so many is worth a column of a matrix product
COSINE, SHARE, LOOSE, ANSWER = 0.4, 0.6, 0.4, 0.8
SEED = 20240611


def words_of(text: str | None) -> np.ndarray:
    return Words(pa.array([text or ""]), keep=ALNUM, lower=True).hashes()


def answer_of(text: str) -> str:
    """The last sentence (the whole text if it is one sentence)."""
    parts = [p for p in re.split(r"(?<=[.!?:])\s+", text.strip()) if p.strip()]
    return parts[-1] if parts else text


@dataclass
class Block:
    """Up to ITEMS items with their vocabulary."""
    ids: list
    items: list[np.ndarray]
    answers: list[np.ndarray]

    def __post_init__(self):
        self.vocab = np.unique(np.concatenate([*self.items, np.zeros(0, np.uint64)]))
        self.slots = _slots(self.vocab)
        self.numbers = [np.searchsorted(self.vocab, h) for h in self.items]
        #: term entries of the items' passages: (passage, term), and the item of each passage
        entries, self.owner = [], []
        for n, h in enumerate(self.items):
            terms = np.searchsorted(self.vocab, h)
            for p in range(max(1, -(-len(h) // HALF) - 1)):
                own = np.unique(terms[p * HALF:(p + 2) * HALF])
                entries.append(np.stack([np.full(len(own), len(self.owner)), own]))
                self.owner.append(n)
        self.entries = np.concatenate(entries, axis=1) if entries else np.zeros((2, 0), int)
        self.owner = np.array(self.owner, np.int64)

    def terms(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ascending positions of the vocabulary's words among ``h``, and their numbers."""
        table, crowded = self.slots
        number = table[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        at = np.flatnonzero(number >= 0)
        number = number[at]
        hit = self.vocab[number] == h[at]
        at, number = at[hit], number[hit]
        for n in crowded:  # words whose slot another one has
            more = np.flatnonzero(h == self.vocab[n])
            at, number = np.append(at, more), np.append(number, np.full(len(more), n))
        order = np.argsort(at, kind="stable") if len(crowded) else slice(None)
        return at[order], number[order].astype(np.int64)


SLOT_BITS = 20


def _slots(vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A table from the top bits of a word's hash to its number, and the numbers of
    words that found their slot taken."""
    own = np.arange(len(vocab))
    slot = (vocab[own] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    table = np.full(1 << SLOT_BITS, -1, np.int32)
    table[slot[::-1]] = own[::-1]
    return table, own[table[slot] != own]


def _distinct(v: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers (32-bit sorting is much faster)."""
    if len(v) and v.max() < 1 << 31:
        v = v.astype(np.int32)
    v = np.sort(v)
    keep = np.ones(len(v), bool)
    keep[1:] = v[1:] != v[:-1]
    return v[keep].astype(np.int64)


class Passages:
    """Passages of a slice of texts with their distinct vocabulary terms."""

    def __init__(self, batch: pa.RecordBatch, block: Block):
        self.words = Words(batch.column("text"), keep=ALNUM, lower=True)
        self.hashes = self.words.hashes()
        counts = np.diff(self.words.bounds)
        halves = -(-counts // HALF)
        self.first = np.cumsum(halves) - halves  # number of a document's first half
        passages = np.where(halves > 0, np.maximum(halves - 1, 1), 0)
        self.total = int(passages.sum())
        at, term = self.at, self.number = block.terms(self.hashes)
        doc = self.words.doc[at]
        half = self.first[doc] + (at - self.words.bounds[doc]) // HALF
        # A half belongs to the passage that begins with it and to the one before.
        local = half - self.first[doc]
        begins = local < passages[doc]
        follows = local > 0
        passage = np.concatenate([half[begins], half[follows] - 1])
        term = np.concatenate([term[begins], term[follows]])
        size = max(1, len(block.vocab))
        both = _distinct(passage * size + term)
        self.passage, self.term = both // size, both % size

    def place(self, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, first word in the slice) of passages."""
        doc = np.searchsorted(self.first, passage, "right") - 1
        return doc, self.words.bounds[doc] + (passage - self.first[doc]) * HALF


def _rows(passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct passages of sorted entries, and where each begins."""
    new = np.ones(len(passage), bool)
    new[1:] = passage[1:] != passage[:-1]
    head = np.flatnonzero(new)
    return passage[head], head


def _places(words: Words, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the words at ``at`` with the words before and after them."""
    full = np.flatnonzero(np.diff(words.bounds))
    before, after = np.zeros_like(h), np.zeros_like(h)
    before[1:], after[:-1] = h[:-1], h[1:]
    before[words.bounds[full]] = 0  # texts end
    after[words.bounds[full + 1] - 1] = 0
    x = h[at] + before[at] * np.uint64(0xC2B2AE3D27D4EB4F) + after[at] * np.uint64(0x165667B19E3779F9)
    for k in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
        x = (x ^ x >> np.uint64(31)) * np.uint64(k)
    return x ^ x >> np.uint64(29)


def _register(registers: np.ndarray, term: np.ndarray, places: np.ndarray) -> None:
    """Count the terms' places: registers (terms x REGISTERS) of most leading zeros."""
    _, size = np.frexp((places & np.uint64((1 << 52) - 1)).astype(np.float64))
    flat = term * REGISTERS + (places >> np.uint64(52)).astype(np.int64) % REGISTERS
    np.maximum.at(registers.reshape(-1), flat, (53 - size).astype(np.uint8))


def _distinct_places(registers: np.ndarray) -> np.ndarray:
    """Estimated number of distinct places of each term (HyperLogLog)."""
    m = registers.shape[1]
    free = (registers == 0).sum(axis=1)
    rough = 0.7213 / (1 + 1.079 / m) * m * m / np.power(2.0, -registers.astype(np.float64)).sum(axis=1)
    return np.where((rough < 2.5 * m) & (free > 0), m * np.log(m / np.maximum(free, 1)), rough)


def _blobs(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of ``values`` that are not all zero, as (first row, bytes) of about 1 MB."""
    step = max(1, (1 << 20) // max(1, values.itemsize * values.shape[1]))
    for at in range(0, len(values), step):
        if values[at:at + step].any():
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([values[at:at + step].tobytes()], pa.binary())],
                                             names=["at", "z"])


def _uses(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = held.value
        registers, total = np.zeros((len(block.vocab), REGISTERS), np.uint8), 0
        for batch in pieces(batches, "text"):
            words = Words(batch.column("text"), keep=ALNUM, lower=True)
            h = words.hashes()
            at, term = block.terms(h)
            if len(at):
                _register(registers, term, _places(words, h, at))
            halves = -(-np.diff(words.bounds) // HALF)
            total += int(np.where(halves > 0, np.maximum(halves - 1, 1), 0).sum())
        yield from _blobs(registers)
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([np.array([total], np.int64).tobytes()], pa.binary())],
                                         names=["at", "z"])
    return run


def _weighted(term: np.ndarray, head: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the entries, each passage scaled to length one."""
    v = weight[term]
    norm = np.sqrt(np.add.reduceat(v * v, head)) if len(head) else v
    return v / np.repeat(norm, np.diff(np.append(head, len(term))))


def _projected(v: np.ndarray, term: np.ndarray, head: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sums of the entries' basis rows times ``v``, a row for each head. Terms that one passage
    in ``OFTEN`` has are taken as one matrix product, the others entry by entry."""
    n = len(head)
    row = np.repeat(np.arange(n), np.diff(np.append(head, len(term))))
    often = np.flatnonzero(np.bincount(term, minlength=len(basis)) * OFTEN >= max(n, 1))
    column = np.full(len(basis), -1)
    column[often] = np.arange(len(often))
    place = column[term]
    own = place >= 0
    dense = np.zeros((n, len(often)), np.float32)
    dense[row[own], place[own]] = v[own]
    out = dense @ basis[often]
    v, term = v[~own], term[~own]
    size = np.bincount(row[~own], minlength=n)
    first = np.cumsum(size) - size
    for lo in range(0, n, 512):  # what fits the processor's cache
        order = lo + np.argsort(-size[lo:lo + 512], kind="stable")
        total = np.zeros((len(order), basis.shape[1]), np.float32)
        for k in range(size[order[0]]):  # the k-th entry of all passages that have one
            at = first[order[:np.searchsorted(-size[order], -k)]] + k
            part = basis[term[at]]
            part *= v[at, None]
            total[:len(at)] += part
        out[order] += total
    return out


def _sketch(z: np.ndarray, passage, term, weight, omega) -> None:
    """Add the passages' part of A'A.Omega to ``z``."""
    if not len(term):
        return
    _, head = _rows(passage)
    v = _weighted(term, head, weight).astype(np.float32)
    edge = np.append(head, len(term))
    for lo in range(0, len(head), SKETCH):
        hi = min(lo + SKETCH, len(head))
        a, b = edge[lo], edge[hi]
        y = _projected(v[a:b], term[a:b], head[lo:hi] - a, omega)
        order = np.argsort(term[a:b], kind="stable")
        row = np.repeat(np.arange(hi - lo), np.diff(edge[lo:hi + 1]))[order]
        own, scale = term[a:b][order], v[a:b][order]
        for k in range(0, len(own), 1024):
            t, first = _rows(own[k:k + 1024])
            part = y[row[k:k + 1024]]
            part *= scale[k:k + 1024, None]
            z[t] += np.add.reduceat(part, first)


def _products(gram: np.ndarray, passage, term, weight) -> None:
    """Add the passages' part of A'A to the upper triangle of ``gram``: a passage has at most
    2 * HALF terms, so their pairs are far fewer than their rows of Omega are long."""
    if not len(term):
        return
    _, head = _rows(passage)
    v = _weighted(term, head, weight).astype(np.float32)
    size = np.diff(np.append(head, len(term)))
    order = np.argsort(size, kind="stable")  # passages of as many terms at a time
    flat = gram.reshape(-1)
    for same in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        i, j = np.triu_indices(size[same[0]])
        for k in range(0, len(same), SKETCH):
            at = head[same[k:k + SKETCH]][:, None] + np.arange(size[same[0]])
            t, x = term[at], v[at]  # a passage's terms ascend
            np.add.at(flat, (t[:, i] * len(gram) + t[:, j]).ravel(), (x[:, i] * x[:, j]).ravel())


def _sketches(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight, omega = held.value
        z = np.zeros(omega.shape, np.float32)
        size = len(omega)
        gram = np.zeros((size, size), np.float32) if size * size <= GRAM else None
        for batch in pieces(batches, "text"):
            p = Passages(batch, block)
            if gram is None:
                _sketch(z, p.passage, p.term, weight, omega)
            else:
                _products(gram, p.passage, p.term, weight)
        if gram is not None:
            gram[np.arange(size), np.arange(size)] /= 2
            for k in range(0, size, 512):
                z[k:k + 512] = (gram[k:k + 512] + gram[:, k:k + 512].T) @ omega
        yield from _blobs(z)
    return run


def _merged(kind: type, add):
    """Blobs of equal place put together, from rows sorted by ``at``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.astype(kind).tobytes()])], names=["at", "z"])

        for batch in batches:
            for k, blob in zip(*(c.to_pylist() for c in batch.columns)):
                v = np.frombuffer(blob, kind)
                if k != at and at is not None:
                    yield row()
                total = v.astype(np.float64 if kind is np.float32 else v.dtype) if k != at else add(total, v)
                at = k
        if at is not None:
            yield row()
    return run


def right_vectors(z: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """Right singular vectors of A from Z = A'A.Omega (one pass, Nystroem form)."""
    z, omega = z.astype(np.float64), omega.astype(np.float64)
    shift = 1e-7 * max(np.linalg.norm(z), 1e-30)
    z = z + shift * omega
    core = omega.T @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values[-1], 1e-30) * 1e-10
    f = z @ (vectors[:, good] / np.sqrt(values[good]))
    u, s, _ = np.linalg.svd(f, full_matrices=False)
    return u[:, s > s[0] * 1e-6].astype(np.float32)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence (bit-parallel over ``a``)."""
    place: dict[int, int] = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = place.get(x)
        if hit:
            u = row & hit
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class Sequences:
    """Word sequences (numbers below ``size``) to be compared with many windows at once."""

    def __init__(self, sequences: list[list[int]], size: int):
        self.sequences, self.length = sequences, np.array([len(x) for x in sequences], np.int64)
        #: bit i of places[n, w]: word w is the i-th of sequence n. Longer sequences go one by one.
        self.places = np.zeros((len(sequences), size + 1), np.uint64)
        for n, words in enumerate(sequences):
            for k, w in enumerate(words[:64]):
                if w >= 0:
                    self.places[n, w] |= np.uint64(1 << k)

    def lcs(self, which: np.ndarray, text: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Longest common subsequence of sequence ``which`` and text[left:right], for each entry:
        bit-parallel over a sequence's words, side by side over the entries."""
        out = np.zeros(len(which), np.int64)
        short = self.length[which] <= 64
        for i in np.flatnonzero(~short):
            out[i] = lcs(self.sequences[which[i]], text[left[i]:right[i]].tolist())
        order = np.flatnonzero(short)
        order = order[np.argsort((right - left)[order], kind="stable")]
        none = self.places.shape[1] - 1
        for k in range(0, len(order), 4096):
            own = order[k:k + 4096]
            n, size = which[own], (right - left)[own]
            at = left[own][:, None] + np.arange(int(size.max(initial=0)))
            words = np.where(at < right[own][:, None], text[np.minimum(at, max(len(text) - 1, 0))], none)
            full = np.array([(1 << int(x)) - 1 for x in self.length[n]], np.uint64)
            row = full.copy()
            for column in np.ascontiguousarray(words.T):
                u = row & self.places[n, column]
                row = ((row + u) | (row - u)) & full
            out[own] = self.length[n] - np.bitwise_count(row)
        return out


def _search(held, limits):
    cosine, share_min, loose, answer_min = limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weight, basis, targets = held.value
        size = len(block.vocab)
        items = Sequences([n.tolist() for n in block.numbers], size)
        spot = {h: n for n, h in enumerate(block.vocab.tolist())}
        answers = Sequences([[spot.get(h, -1) for h in a.tolist()] for a in block.answers], size)
        ids = pa.array(block.ids, pa.int64())
        for batch in pieces(batches, "text"):
            p = Passages(batch, block)
            if not len(p.term):
                continue
            rows, head = _rows(p.passage)
            v = _weighted(p.term, head, weight).astype(np.float32)
            edge = np.append(head, len(p.term))
            for lo in range(0, len(head), 4096):
                hi = min(lo + 4096, len(head))
                a, b = edge[lo], edge[hi]
                y = _projected(v[a:b], p.term[a:b], head[lo:hi] - a, basis)
                norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", y, y)), np.float32(1e-12))
                near = y @ targets.T
                r, t = np.nonzero(near >= np.float32(cosine) * norm[:, None])
                if not len(r):
                    continue
                pair = r * len(items.length) + block.owner[t]
                order = np.argsort(pair, kind="stable")
                pair, first = _rows(pair[order])
                best = np.maximum.reduceat((near[r, t] / norm[r])[order], first)
                passage, item = rows[lo + pair // len(items.length)], pair % len(items.length)
                doc, start = p.place(passage)
                # Other words than the items' are in no common subsequence.
                reach = items.length[item]
                left = np.searchsorted(p.at, np.maximum(p.words.bounds[doc], start - reach))
                right = np.searchsorted(p.at, np.minimum(p.words.bounds[doc + 1], start + 2 * HALF + reach))
                kept = np.flatnonzero(right - left >= loose * reach)
                whole = items.lcs(item[kept], p.number, left[kept], right[kept]) / reach[kept]
                kept, whole = kept[whole >= loose], whole[whole >= loose]
                part = answers.lcs(item[kept], p.number, left[kept], right[kept]) / np.maximum(answers.length[item[kept]], 1)
                leak = (whole >= share_min) | (part >= answer_min)
                kept, whole, part = kept[leak], whole[leak], part[leak]
                if len(kept):
                    d = doc[kept]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(d)), ids.take(pa.array(item[kept])), pa.array(whole),
                         pa.array(part), pa.array(best[kept].astype(float)), pa.array(start[kept] - p.words.bounds[d])],
                        names=["doc_id", "item_id", "lcs_share", "answer_share", "cosine", "word"])
    return run


_LEAKS = "doc_id long, item_id long, lcs_share double, answer_share double, cosine double, word long"


def _block(rows) -> Block:
    items = [(r["item_id"], r["text"]) for r in rows]
    hashes = [words_of(t) for _, t in items]
    keep = [i for i, h in enumerate(hashes) if len(h)]
    return Block([items[i][0] for i in keep], [hashes[i] for i in keep],
                 [words_of(answer_of(items[i][1])) for i in keep])


def _together(parts: DataFrame, merge) -> list:
    return in_tasks(parts.repartition("at").sortWithinPartitions("at"), merge, "at long, z binary").collect()


def _block_leaks(texts: DataFrame, block: Block, limits: tuple[float, ...]) -> DataFrame:
    sc = texts.sparkSession.sparkContext
    registers, total = np.zeros((len(block.vocab), REGISTERS), np.uint8), 0
    parts = saved(in_tasks(texts, _uses(sc.broadcast(block)), "at long, z binary"), "uses")
    for r in _together(parts.where("at >= 0"), _merged(np.uint8, np.maximum)):
        part = np.frombuffer(r["z"], np.uint8).reshape(-1, REGISTERS)
        registers[r["at"]:r["at"] + len(part)] = part
    for r in _together(parts.where("at < 0"), _merged(np.int64, np.add)):
        total = int(np.frombuffer(r["z"], np.int64)[0])
    weight = np.log1p((total + PRIOR) / (_distinct_places(registers) + 1))
    passage, term = block.entries
    rows, head = _rows(passage)
    rank = min(len(block.vocab), len(rows) + EXTRA_RANK)
    omega = np.random.default_rng(SEED).standard_normal((len(block.vocab), rank)).astype(np.float32)
    parts = in_tasks(texts, _sketches(sc.broadcast((block, weight, omega))), "at long, z binary")
    sums = _together(parts, _merged(np.float32, np.add))
    z = np.zeros(omega.shape, np.float32)
    for r in sums:
        part = np.frombuffer(r["z"], np.float32).reshape(-1, rank)
        z[r["at"]:r["at"] + len(part)] += part
    _sketch(z, passage, term, weight, omega)
    basis = right_vectors(z, omega)
    v = _weighted(term, head, weight)
    targets = np.add.reduceat(v[:, None] * basis[term], head).astype(np.float32)
    targets /= np.maximum(np.sqrt((targets * targets).sum(axis=1, keepdims=True)), 1e-12)
    block.owner = block.owner[rows]
    return in_tasks(texts, _search(sc.broadcast((block, weight, basis, targets)), limits), _LEAKS)


def leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          cosine: float = COSINE, share: float = SHARE, loose: float = LOOSE, answer: float = ANSWER) -> DataFrame:
    """One row per (doc_id, item_id) that leaks: the best shares and the first word
    of the passage they were found at."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    n = items.count()
    number = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, -(-n // ITEMS))))
    found = None
    for b in range(-(-n // ITEMS)):
        block = _block(items.where(number == b).orderBy("item_id", "text").collect())
        if block.ids:
            part = _block_leaks(texts, block, (cosine, share, loose, answer))
            found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], _LEAKS)
    return found.groupBy("doc_id", "item_id").agg(
        F.max(F.struct("lcs_share", "answer_share", "cosine", F.negative("word").alias("at"))).alias("best")) \
        .select("doc_id", "item_id", "best.lcs_share", "best.answer_share", "best.cosine",
                F.negative("best.at").alias("word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those whose text leaks an item: rows without an id, and rows that
    share one, are judged by their own texts (told apart by a 64-bit hash)."""
    key = F.xxhash64(F.col(f"`{text_col}`"))
    bad = leaks(docs.select(key.alias("doc_id"), F.col(f"`{text_col}`").alias("text")), benchmark, **options) \
        .select(F.col("doc_id").alias("leaking")).distinct()
    return docs.join(bad, F.xxhash64(docs[f"`{text_col}`"]) == bad["leaking"], "left_anti")
