"""Language identification with spans of mixed-language text.

1. Words are runs of letters; the script of a word's first letter narrows the
   languages to those that use the script in the training rows.
2. Every remaining language scores the word: log-probabilities of its byte
   trigrams and of the word itself, in hashed tables of fixed size.
3. A Viterbi pass over the words of a document, with a penalty for changing the
   language, labels them; equal neighbours make spans. The document's language is
   the one with most letters in its spans, the score its share of them.

Training rows are taken up to ``SAMPLE`` whole texts of each language, by a hash
of the id; their counts are summed by Spark and only the tables (a size fixed by
``BUCKETS`` and the number of languages) reach the driver. All texts are labelled
whole; long texts are cut into segments whose best paths are joined exactly.

Nulls and ties: a null text, or one without letters, is ``und`` with score 0 and
no spans; so is every text if no training row has a language. Rows with a null
language are not learned from. Equal scores go to the language first in the
alphabet. Rows are labelled one by one, so repeated rows agree; empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refinery.llm.store import in_tasks
from refinery.llm.textbatch import LOWER, Words, pieces

SAMPLE = 2_000
BUCKETS = 1 << 16  # of trigrams, and as many of words
SWITCH = 12.0
FLOOR = -40.0  # least score of a word against the best language
SEGMENT = 128
MIN_SHARE = 0.001  # of a language's words, for a script to count as its own

#: First code points of ranges and their scripts (blocks of the Unicode standard; 0 is no letter). Fixed values.
SCRIPTS = (
    (0x0000, 1), (0x0080, 0), (0x00C0, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6),
    (0x0700, 7), (0x0900, 8), (0x0980, 9), (0x0A00, 10), (0x0A80, 11), (0x0B00, 12), (0x0B80, 13), (0x0C00, 14),
    (0x0C80, 15), (0x0D00, 16), (0x0D80, 17), (0x0E00, 18), (0x0E80, 19), (0x0F00, 20), (0x1000, 21), (0x10A0, 22),
    (0x1100, 23), (0x1200, 24), (0x13A0, 25), (0x1780, 26), (0x1800, 27), (0x1E00, 1), (0x1F00, 2), (0x2000, 0),
    (0x2C00, 7), (0x3000, 0), (0x3040, 28), (0x30A0, 29), (0x3100, 30), (0x3130, 23), (0x3190, 30), (0xA000, 31),
    (0xA640, 3), (0xA720, 1), (0xAC00, 23), (0xD7B0, 0), (0xF900, 30), (0xFB00, 1), (0xFB1D, 5), (0xFB50, 6),
    (0xFE00, 0), (0xFE70, 6), (0xFF00, 0), (0xFF21, 1), (0xFF66, 29), (0xFFA0, 23), (0xFFE0, 0),
    (0x10000, 31), (0x1F000, 0), (0x20000, 30), (0xE0000, 0),
)
_FROM = np.array([a for a, _ in SCRIPTS])
_SCRIPT = np.array([s for _, s in SCRIPTS])
N_SCRIPTS = 32

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points that begin at byte positions ``at``."""
    padded = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int64)
    a, b, c, d = (padded[at + i] for i in range(4))
    return np.select([a < 0x80, a < 0xE0, a < 0xF0],
                     [a, (a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63],
                     (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63)


class LetterWords(Words):
    """Runs of letters, with script and buckets. Runs of other characters above
    ASCII (dashes, quotes, symbols) count as words of script 0."""

    def __init__(self, column: pa.Array):
        super().__init__(column, keep=_LETTER)
        self.script = _SCRIPT[np.searchsorted(_FROM, _code_points(self.data, self.starts), "right") - 1] \
            if len(self) else np.zeros(0, np.int64)
        for i in np.flatnonzero(self.script == 0):  # rare: letters after a mark, or marks only
            letters = [c for c in self.data[self.starts[i]:self.ends[i]].tobytes().decode("utf8", "replace") if c.isalpha()]
            if letters:
                self.script[i] = max(1, _SCRIPT[np.searchsorted(_FROM, ord(letters[0]), "right") - 1])
        self.size = self.ends - self.starts
        low = LOWER[self.data]
        inside = _LETTER[self.data]
        d = np.concatenate([[np.uint8(32)], np.where(inside, low, np.uint8(32)), [np.uint8(32)]]).astype(np.uint32)
        mid = np.flatnonzero(inside)
        before, after = d[mid], d[mid + 2]
        edge = np.cumsum(self.size) - self.size  # word ends at document borders have no separator
        if len(self):
            before[edge] = 32
            after[edge + self.size - 1] = 32
        code = before << np.uint32(16) | d[mid + 1] << np.uint32(8) | after
        code = (code ^ code >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
        self.grams = (code >> np.uint32(12)) & np.uint32(BUCKETS - 1)
        self.edge = edge
        self.data = low
        self.word_bucket = (self.hashes() >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n); scripts are counted in the buckets after the words'."""
    total: dict[str, np.ndarray] = {}
    for batch in pieces(batches, "text"):
        w = LetterWords(batch.column("text"))
        lang = np.array(batch.column("lang").to_pylist(), object)
        of_word = lang[w.doc] if len(w) else lang[:0]
        of_gram = np.repeat(of_word, w.size)
        for name in set(lang):
            t = total.setdefault(name, np.zeros(2 * BUCKETS + N_SCRIPTS, np.int64))
            mine = (of_word == name) & (w.script > 0)
            t[:BUCKETS] += np.bincount(w.grams[(of_gram == name) & np.repeat(w.script > 0, w.size)], minlength=BUCKETS)
            t[BUCKETS:2 * BUCKETS] += np.bincount(w.word_bucket[mine], minlength=BUCKETS)
            t[2 * BUCKETS:] += np.bincount(w.script[mine], minlength=N_SCRIPTS)
    for name, t in total.items():
        some = np.flatnonzero(t)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()),
                                          pa.array(t[some])], names=["lang", "bucket", "n"])


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: (languages, 2 * BUCKETS + N_SCRIPTS)"""
        self.langs = langs
        parts = []
        for part in (counts[:, :BUCKETS], counts[:, BUCKETS:2 * BUCKETS]):
            parts.append(np.log((part + 0.5) / (part.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32))
        self.grams, self.words = parts
        script = counts[:, 2 * BUCKETS:].astype(float)
        share = script / np.maximum(script.sum(axis=1, keepdims=True), 1)
        self.candidates = (share >= MIN_SHARE).T  # (script, language)
        self.candidates[~self.candidates.any(axis=1)] = True

    def emissions(self, w: LetterWords) -> np.ndarray:
        """(words, languages) relative to the best language of each word; script-less
        words say nothing."""
        out = np.empty((len(w), len(self.langs)), np.float32)
        for i in range(len(self.langs)):
            out[:, i] = np.add.reduceat(self.grams[i][w.grams], w.edge) + self.words[i][w.word_bucket]
        out[~self.candidates[w.script]] = -np.inf
        out -= out.max(axis=1, keepdims=True)
        np.maximum(out, FLOOR, out=out)
        out[w.script == 0] = 0.0
        return out


def train(docs: DataFrame, *, sample: int = SAMPLE) -> Model:
    """``docs``: the rows (doc_id, text, lang) to learn from."""
    docs = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    size = docs.groupBy("lang").agg(F.count("*").alias("n"))
    hashed = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 30))
    # One row a language (as many as the model holds): texts are not dealt by language.
    taken = docs.join(F.broadcast(size), "lang").where(hashed < F.lit(float(1 << 30)) * sample / F.col("n")) \
        .select("lang", "text")
    sums = in_tasks(taken, _counts, "lang string, bucket int, n long") \
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    counts = np.zeros((len(langs), 2 * BUCKETS + N_SCRIPTS), np.int64)
    counts[np.searchsorted(langs, sums["lang"]) if langs else [], sums["bucket"]] = sums["n"]
    return Model(langs, counts)


def viterbi(e: np.ndarray, bounds: np.ndarray, switch: float, segment: int = SEGMENT) -> np.ndarray:
    """Best state of every word. ``e``: (words, states) scores; ``bounds``: word range
    of each document; ``switch``: the cost of another state than the word before.

    Documents are cut into segments, walked side by side. A first walk finds each
    segment's best score from every entry to every exit state; these are joined
    along the document, which gives the exact scores at each segment's entry for
    the second walk and the exact exit state for its trace back."""
    n, states = e.shape
    if not n or states == 1:
        return np.zeros(n, np.int64)
    counts = np.diff(bounds)
    pieces_of = -(-counts // segment)
    n_seg = int(pieces_of.sum())
    first_seg = np.cumsum(pieces_of) - pieces_of
    ordinal = np.arange(n_seg) - np.repeat(first_seg, pieces_of)
    start = np.repeat(bounds[:-1], pieces_of) + ordinal * segment
    size = np.minimum(np.repeat(bounds[1:], pieces_of) - start, segment)
    by_size = np.argsort(-size, kind="stable")  # at step t the first active[t] segments are still walked
    start, size = start[by_size], size[by_size]
    place = np.empty(n_seg, np.int64)
    place[by_size] = np.arange(n_seg)
    active = np.searchsorted(-size, -np.arange(1, segment + 1), "right")

    def step(v, t, k):
        return np.maximum(v[:k], v[:k].max(axis=-1, keepdims=True) - switch)

    entry = np.zeros((n_seg, states), np.float32)
    several = np.flatnonzero(pieces_of > 1)
    if len(several):
        v = np.where(np.eye(states, dtype=bool), 0.0, -1e9).astype(np.float32)
        v = np.broadcast_to(v, (n_seg, states, states)).copy()
        for t in range(segment):
            k = int(active[t])
            if not k:
                break
            v[:k] = step(v, t, k) + e[start[:k] + t][:, None, :]
        for j in range(int(pieces_of.max()) - 1):
            own = several[pieces_of[several] > j + 1]
            here, after = place[first_seg[own] + j], place[first_seg[own] + j + 1]
            joined = (entry[here][:, :, None] + v[here]).max(axis=1)
            entry[after] = joined - joined.max(axis=1, keepdims=True)
        del v
    v = entry.copy()
    number = np.min_scalar_type(states - 1)
    back = np.empty((segment, n_seg, states), number)
    own_state = np.arange(states, dtype=number)
    for t in range(segment):
        k = int(active[t])
        if not k:
            break
        best = v[:k].argmax(axis=1)
        top = v[np.arange(k), best][:, None] - switch
        stay = v[:k] >= top
        back[t, :k] = np.where(stay, own_state, best[:, None].astype(number))
        v[:k] = np.where(stay, v[:k], top) + e[start[:k] + t]
    origin = np.broadcast_to(own_state, (n_seg, states)).copy()  # state before the segment, by exit state
    for t in range(segment - 1, -1, -1):
        k = int(active[t])
        if k:
            origin[:k] = np.take_along_axis(back[t, :k], origin[:k].astype(np.int64), axis=1)
    exit_state = np.zeros(n_seg, np.int64)
    last = place[(first_seg + pieces_of - 1)[pieces_of > 0]]
    exit_state[last] = v[last].argmax(axis=1)
    for j in range(int(pieces_of.max()) - 1, 0, -1):
        own = np.flatnonzero(pieces_of > j)
        here, before = place[first_seg[own] + j], place[first_seg[own] + j - 1]
        exit_state[before] = origin[here, exit_state[here]]
    out = np.zeros(n, np.int64)
    state = exit_state
    for t in range(segment - 1, -1, -1):
        k = int(active[t])
        if k:
            out[start[:k] + t] = state[:k]
            state[:k] = back[t, np.arange(k), state[:k]]
    return out


_SPAN = pa.list_(pa.struct([("lang", pa.string()), ("first_byte", pa.int64()), ("end_byte", pa.int64())]))


def _label(model, switch: float, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        n_langs = max(len(m.langs), 1)
        for batch in pieces(batches, "text"):
            w = LetterWords(batch.column("text"))
            docs = batch.num_rows
            state = viterbi(m.emissions(w), w.bounds, switch) if m.langs else np.zeros(len(w), np.int64)
            letters = np.bincount(w.doc * n_langs + state, w.size * (w.script > 0),
                                  minlength=docs * n_langs).reshape(docs, n_langs)
            total = letters.sum(axis=1)
            best = letters.argmax(axis=1)
            some = (total > 0) & bool(m.langs)
            names = np.array([*m.langs, "und"], object)
            columns = [batch.column("doc_id"), pa.array(names[np.where(some, best, len(m.langs))], pa.string()),
                       pa.array(np.where(some, letters[np.arange(docs), best] / np.maximum(total, 1), 0.0))]
            if spans:
                columns.append(_spans(w, state, some, names))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang", "score", "spans"][:len(columns)])
    return run


def _spans(w: LetterWords, state: np.ndarray, some: np.ndarray, names: np.ndarray) -> pa.Array:
    new = np.ones(len(w), bool)
    new[1:] = (state[1:] != state[:-1]) | (w.doc[1:] != w.doc[:-1])
    new &= some[w.doc]
    head = np.flatnonzero(new)
    following = np.flatnonzero(np.append(new[1:], True) | np.append(w.doc[1:] != w.doc[:-1], True)) \
        if len(w) else head
    tail = following[some[w.doc[following]]] if len(w) else head
    base = w.offsets[w.doc[head]]
    flat = pa.StructArray.from_arrays([pa.array(names[state[head]], pa.string()), pa.array(w.starts[head] - base),
                                       pa.array(w.ends[tail] - base)], fields=list(_SPAN.value_type))
    edge = np.searchsorted(w.doc[head], np.arange(len(some) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edge), flat)


def identify(docs: DataFrame, model: Model, *, switch: float = SWITCH, spans: bool = True,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, score and spans (language, byte range in the text) per row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ddl = "doc_id long, lang string, score double"
    if spans:
        ddl += ", spans array<struct<lang: string, first_byte: long, end_byte: long>>"
    return in_tasks(texts, _label(held, switch, spans), ddl)


def predictions(docs: DataFrame) -> DataFrame:
    """Learned on documents whose remainder of 4 is not 2, applied to all."""
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    model = train(docs.where(remainder != 2))
    return identify(docs, model).select(
        "doc_id", (remainder == 2).alias("held_out"), F.col("lang").alias("lang_pred"), "score", "spans")
