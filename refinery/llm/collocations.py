"""Collocations by top-order marginalisation.

At each word, lead columns hold the next three words of its piece (null beyond its
end): one padded window of the longest order. Only these windows are counted; Spark's
ROLLUP over their columns then sums them to every shorter prefix, which gives the
frequency of all phrases of one to four words without exploding n-grams of each order.

A window also ends before a word that makes its prefix rare for certain: candidates of
``LEAST`` occurrences, and the parts of candidates, are no rarer, so they keep their exact
frequency (single words keep all theirs), and rare tails collapse in the task that reads
them. Certainty comes from tables of counters, one for each order, indexed by a hash of
(lang, phrase), each an upper bound of its phrases' counts; a phrase is counted only if its
parts may be frequent. A table's size follows the number of bytes up to a bound
(``sketch.MAX_SLOTS``); a fuller one ends fewer windows, which costs shuffle and changes
no result.

All counts are exact: words are told apart by their bytes, and scores are computed with
decimals. Everything after the windows is joins and aggregates on phrases that occur
``LEAST`` times; hot words and languages are collapsed map-side.

Nulls and ties: a null text has no words, a null lang is ``und`` (with the documents
whose lang is ``und``). Repeated rows count each time. Equal scores rank by ``a``, then
by phrase in byte order, so ranks are unique. Texts of any length are handled whole.
Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refinery.llm.sketch import frequent, reached, slots_for
from refinery.llm.store import in_tasks, saved
from refinery.llm.textbatch import Words, mix, pieces, ragged

ORDER, LEAST, TOP, NONE = 4, 30, 2000, "und"
#: A candidate goes if a longer one that holds it has this share (percent) of its occurrences.
HELD = 80
SLICE_BYTES = 2 << 20
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_ENDS
_WORD[[0x20, 0x09]] = False
_M = np.uint64(0x9E3779B97F4A7C15)


class _Slice:
    """Words of a slice of documents, with the language and the piece of each."""

    def __init__(self, batch: pa.RecordBatch):
        self.words = words = Words(batch.column("text"), _WORD, lower=True)
        langs = batch.column("lang").dictionary_encode()
        self.langs, self.lang = langs.dictionary, np.asarray(langs.indices)[words.doc]
        piece = np.cumsum(_ENDS[words.data])[words.starts] if len(words) else np.zeros(0, np.int64)
        self.follows = np.zeros(len(words), bool)  # the next word is of the same piece
        self.follows[:-1] = (piece[1:] == piece[:-1]) & (words.doc[1:] == words.doc[:-1])

    def lasting(self, often: list[np.ndarray], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 2, 3, ... ``order`` words from each word on: whether they are of one piece and, as far
        as ``often`` (bits for each of these orders) goes, may be frequent; and their hash."""
        n, h = len(self.words), self.words.hashes()
        salt = np.array([hash_of(x) for x in self.langs.to_pylist()], np.uint64)
        phrase = mix(h ^ salt[self.lang]) if n else h
        stays = np.ones(n, bool)
        for m in range(2, order + 1):
            # Both parts of one word less stay, and no piece ends between.
            stays = np.append(stays[:-1] & stays[1:] & self.follows[:-1], False)[:n] if m > 2 else self.follows.copy()
            phrase = np.append(mix(phrase[:n - m + 1] * _M ^ h[m - 1:]), np.zeros(min(m - 1, n), np.uint64))[:n]
            if m - 2 < len(often):
                stays &= reached(often[m - 2], phrase)
            yield stays, phrase

    def ids(self) -> tuple[pa.Array, np.ndarray]:
        """Distinct words, and the number of each word among them."""
        size = self.words.ends - self.words.starts
        edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        data = self.words.data[ragged(self.words.starts, size)]
        column = pa.StringArray.from_buffers(len(size), pa.py_buffer(edge), pa.py_buffer(data))
        coded = column.dictionary_encode()
        return coded.dictionary, np.asarray(coded.indices).astype(np.int64)


def hash_of(lang: str) -> int:
    import zlib

    return zlib.crc32(lang.encode()) * 0x9E3779B97F4A7C15 % (1 << 64)


def _phrases(bits: list[bytes], order: int):
    """Hashes of the phrases of ``order`` words whose parts may be frequent."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        often = [np.frombuffer(b, np.uint8) for b in bits]
        for batch in pieces(batches, "text", SLICE_BYTES):
            for stays, phrase in _Slice(batch).lasting(often, order):
                pass
            yield phrase[stays]
    return found


def _windows(bits: list[bytes], order: int):
    """Distinct padded windows of each slice with their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = [np.frombuffer(b, np.uint8) for b in bits]
        for batch in pieces(batches, "text", SLICE_BYTES):
            part = _Slice(batch)
            n = len(part.words)
            if not n:
                continue
            words, ids = part.ids()
            key = part.lang.astype(np.int64) * len(words) + ids
            leads = [ids]
            for j, (stays, _) in enumerate(part.lasting(often, order), 1):
                lead = np.zeros(n, np.int64)  # 0: null
                at = np.flatnonzero(stays)
                lead[at] = ids[at + j] + 1
                leads.append(lead)
                # Windows so far, numbered anew, so that a further word fits beside the number.
                _, key = np.unique(key * (len(words) + 1) + lead, return_inverse=True)
            _, first, count = np.unique(key, return_index=True, return_counts=True)
            columns = [pa.DictionaryArray.from_arrays(pa.array(part.lang[first]), part.langs).dictionary_decode(),
                       words.take(pa.array(ids[first]))]
            for lead in leads[1:]:
                lead = lead[first]
                columns.append(words.take(pa.array(lead - 1, mask=lead == 0)))
            whole = pa.RecordBatch.from_arrays([*columns, pa.array(count.astype(np.int64))],
                                               names=["lang", *_names(order), "n"])
            for at in range(0, whole.num_rows, 65536):
                yield whole.slice(at, 65536)
    return run


def _names(order: int) -> list[str]:
    return [f"w{i + 1}" for i in range(order)]


def window_counts(docs: DataFrame, *, order: int = ORDER, least: int = LEAST, slots: int | None = None,
                  text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, w1 to w<order> (null beyond the end), n: partial counts of padded windows. ``slots``
    (a power of two) sizes the counters; by default from the number of bytes."""
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NONE)).alias("lang"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    if slots is None:
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        slots = slots_for(size // 24)
    often: list[bytes] = []
    for m in range(2, order + 1):
        often.append(frequent(texts, _phrases(often, m), slots, least))
    ddl = ", ".join(["lang string", *(f"{c} string" for c in _names(order)), "n long"])
    return in_tasks(texts, _windows(often, order), ddl)


def frequencies(windows: DataFrame, order: int = ORDER, least: int = LEAST) -> DataFrame:
    """lang, words (array; empty: all of the language's words), n: phrases of one to ``order``
    words that occur ``least`` times, and the languages' totals."""
    names = _names(order)
    longest = windows.groupBy("lang", *names).agg(F.sum("n").alias("n"))
    prefixes = longest.rollup("lang", *names).agg(F.sum("n").alias("n"), F.grouping_id().alias("gid"))
    size = order - F.bit_count("gid")  # words of the prefix; -1: all languages together
    last = F.coalesce(*[F.when(size == i + 1, F.col(c).isNotNull()) for i, c in enumerate(names)])
    return prefixes.where((size == 0) | ((size > 0) & last & (F.col("n") >= least))).select(
        "lang", F.slice(F.array(*names), F.lit(1), size).alias("words"), "n")


def _phrase(words) -> F.Column:
    return F.array_join(words, " ")


def ranked(freq: DataFrame, *, top: int = TOP, least: int = LEAST, held: int = HELD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score from ``frequencies``."""
    phrases = freq.where("size(words) > 0").select("lang", _phrase(F.col("words")).alias("phrase"), F.col("n").alias("a"))
    totals = freq.where("size(words) = 0").select("lang", "n")
    cands = freq.where((F.size("words") >= 2) & (F.col("n") >= least)).select("lang", "words", F.col("n").alias("a"))
    cuts = cands.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", _phrase(F.col("words")).alias("phrase"), "a", "k",
        _phrase(F.slice("words", F.lit(1), F.col("k"))).alias("head"),
        _phrase(F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))).alias("tail"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"]) \
        .join(phrases.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r)")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = cands.where("size(words) > 2").select(
        "lang", "words", "a", F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("m")).select(
        "lang", "words", "a", "m", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("m") + 1)).alias("at")).select(
        "lang", _phrase(F.slice("words", F.col("at"), F.col("m"))).alias("phrase"), "a")
    most = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(most, ["lang", "phrase"], "left") \
        .where(F.expr(f"longer is null or 100 * cast(longer as decimal(20, 0)) < {held} * cast(a as decimal(20, 0))"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, *, order: int = ORDER, least: int = LEAST, top: int = TOP, held: int = HELD,
                 slots: int | None = None) -> DataFrame:
    """Each language's first ``top`` phrases of two to ``order`` words that occur ``least``
    times: lang, rank, phrase, a, l, r, n, score."""
    windows = window_counts(docs, order=order, least=least, slots=slots)
    return ranked(saved(frequencies(windows, order, least), "phrases"), top=top, least=least, held=held)


def brute_force(rows: list[tuple[str | None, str | None]], least: int = LEAST, top: int = TOP, held: int = HELD,
                order: int = ORDER) -> list[tuple]:
    """The contract phrase by phrase over (lang, text), for tests."""
    freq: dict[str, Counter] = {}
    total: Counter = Counter()
    for lang, text in rows:
        lang = NONE if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, order + 1):
                freq.setdefault(lang, Counter()).update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in freq.items():
        cands = [p for p, a in f.items() if len(p) > 1 and a >= least]
        longest: Counter = Counter()
        for p in cands:
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longest[p[i:i + m]] = max(longest[p[i:i + m]], f[p])
        mine = []
        for p in cands:
            if longest[p] and 100 * longest[p] >= held * f[p]:
                continue
            score, _, l, r = min((2000000 * f[p] // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]])
                                 for k in range(1, len(p)))
            mine.append((-score, -f[p], " ".join(p).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(mine)[:top]):
            out.append((lang, i + 1, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)
