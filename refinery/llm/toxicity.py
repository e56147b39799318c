"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on toxic, one on ordinary text. Like a
cover trainer they are made of segments chosen by score: first the words common to
all text, the same in both, then the segments that mark the one class: words, and
beginnings of words, so that a stem with many endings counts as one. A segment's score
is a lower confidence bound of its log-odds between classes, counted once a
document, and copies of a document count once (documents that share any of four
minhashes), so that a group of copies with one label does not become a mark. Of a
beginning and its continuations the longest that has nearly all documents is held, and
a continuation only if it marks more surely. Every other segment that marks a class is
held, and zstandard's tables grow with the dictionary.

A text is cut into windows of ``WINDOW`` words. A window is compressed with either
dictionary, and the difference of the lengths is its distance: where only the toxic
dictionary matches, the toxic one is shorter. Dictionaries and windows share a
leading mark, so that all windows are coded alike and short ones are not stored;
every word stands between marks of its own, so that one of two letters is a match
whatever the words beside it are.
A document's three largest distances are compared with a row of thresholds each,
whose weights a logistic fit calibrates to a probability.

Labelled rows are read up to ``SAMPLE`` of each label, by a hash of the id; all
texts are scored whole.

Nulls and odd inputs: a null or wordless text has no window and distances of zero.
Labels that are null or belong to no document are ignored; a document with two
labels counts for both. If either label is missing the score is the share of label
1 (0.5 without labels). Repeated rows score alike; empty tables give empty results;
extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refinery.llm.minhash import shingle_hashes
from refinery.llm.store import in_tasks, saved
from refinery.llm.textbatch import Words, pieces, utf8

SAMPLE, WINDOW = 8_000, 4
COMMON = 1500  # bytes of a dictionary for words of all text
LEAST_MATCH = 6  # bytes: a word of two letters with the marks around it
_OPEN, _CLOSE = b"((", b"))"
SURE, ODDS = 3.0, 2.0  # standard errors, and the least log-odds, of a marking word
TOXIC_ODDS, NEARLY = 1.0, 0.9  # least log-odds of toxic segments; share of documents of a continuation that replaces it
BEGINNING = 12  # characters of a beginning at most
LEAST_END, END_SHARE = LEAST_MATCH - 2, 0.0002  # of toxic words that occur in ordinary ones: bytes, share of documents
FEATURES = ("first", "second", "third")
#: Thresholds of the largest, second and third distance of a document, in bytes.
STEPS = {"first": range(2, 11), "second": range(2, 8), "third": range(2, 8)}

#: Letters and the bytes of non-ASCII characters, in lower case; everything else separates.
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_MARK = bytes((*range(1, 9), *range(14, 22)))


def _compressor(content: bytes):
    import zstandard

    room = max(13, (2 * len(content)).bit_length())
    alike = Counter(content[i:i + LEAST_MATCH] for i in range(len(content)))  # the matches of a place
    tries = max((n for part, n in alike.items() if part.strip()), default=1)
    params = zstandard.ZstdCompressionParameters(
        window_log=room, hash_log=room - 1, chain_log=room - 1, search_log=max(4, tries.bit_length()),
        min_match=LEAST_MATCH, target_length=0,
        strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=trained, compression_params=params)


def segments(words: list[bytes], size: int | None = None) -> bytes:
    """Words with their marks (beginnings, which end in ``*``, with the first alone), the best
    last (nearest to the text): all, or the best that fit ``size``. The space between two is in no window, so matches end there."""
    held, length = [], 0
    for w in words:
        length += len(_OPEN) + len(w) + len(_CLOSE) + 1
        if size is not None and length > size:
            break
        held.append(_OPEN + (w[:-1] if w.endswith(b"*") else w + _CLOSE) + b" ")
    return b"".join(reversed(held))


@dataclass(frozen=True)
class Dictionaries:
    toxic: bytes
    ordinary: bytes

    @staticmethod
    def of(common: list[bytes], toxic: list[bytes], ordinary: list[bytes]) -> Dictionaries:
        shared = segments(common, COMMON)
        a, b = segments(toxic), segments(ordinary)
        size = max(len(a), len(b))  # equal sizes: shared words are equally far away
        return Dictionaries(shared + a.rjust(size) + _MARK, shared + b.rjust(size) + _MARK)


def _words_of(data: bytes) -> list[bytes]:
    return data.translate(_LETTERS).split()


def _distances(dictionaries: Dictionaries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, ordinary = (_compressor(d).compress for d in (dictionaries.toxic, dictionaries.ordinary))
        for batch in pieces(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            raw = data.tobytes()
            rows = np.zeros((batch.num_rows, len(FEATURES)))
            for i in range(batch.num_rows):
                words = _words_of(raw[offsets[i]:offsets[i + 1]])
                if not words:
                    continue
                d = []
                for at in range(0, len(words), WINDOW):
                    window = _MARK + b"".join(_OPEN + w + _CLOSE for w in words[at:at + WINDOW])
                    d.append(len(ordinary(window)) - len(toxic(window)))
                d = sorted(d, reverse=True)[:len(FEATURES)]
                rows[i, :len(d)] = d
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names) if n != "text"),
                                              *(pa.array(rows[:, j]) for j in range(len(FEATURES)))],
                                             names=[*(n for n in batch.schema.names if n != "text"), *FEATURES])
    return run


_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def _segments_of(words: Iterator[str]) -> set[str]:
    """Words, and their beginnings long enough to be matched, which end in ``*``."""
    out = set()
    for w in words:
        out.add(w)
        for k in range(2, min(len(w), BEGINNING + 1)):
            if k >= LEAST_END or len(w[:k].encode()) >= LEAST_END:
                out.add(w[:k] + "*")
    return out


def _chosen(found: list[tuple[str, float, float]]) -> list[str]:
    """Of marking segments (segment, documents, score; best first) those to hold."""
    documents, score, most = {}, {}, {}
    for s, n, t in found:
        text = s.rstrip("*")
        documents[s] = n
        if s.endswith("*"):
            score[text] = t
        for k in range(2, len(text) + (not s.endswith("*"))):
            most[text[:k]] = max(most.get(text[:k], 0.0), n)
    out = []
    for s, n, t in found:
        text = s.rstrip("*")
        if s.endswith("*") and most.get(text, 0.0) >= NEARLY * n:
            continue  # a continuation has nearly all of its documents
        if any(score.get(text[:k], -1.0) >= t and most.get(text[:k], 0.0) < NEARLY * documents[text[:k] + "*"]
               for k in range(2, len(text) + (not s.endswith("*")))):
            continue  # a beginning that is held marks as surely
        out.append(s)
    return out


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, words, minhashes) of training rows."""
    for batch in pieces(batches, "text"):
        data, offsets = utf8(batch.column("text"))
        raw = data.tobytes()
        h, doc = shingle_hashes(Words(batch.column("text"), lower=True), 3)
        edge = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        words, least = [], []
        for i in range(batch.num_rows):
            found = set(_words_of(raw[offsets[i]:offsets[i + 1]]))
            words.append(sorted(_segments_of(w.decode("utf8", "replace") for w in found)))
            own = h[edge[i]:edge[i + 1]]
            least.append([int((own * s >> np.uint64(2)).min()) for s in _SALTS] if len(own) else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), batch.column("text"),
             pa.array(words, pa.list_(pa.string())), pa.array(least, pa.list_(pa.int64()))],
            names=["doc_id", "label", "text", "words", "least"])


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    size = labels.groupBy("label").agg(F.count("*").alias("n"))
    taken = labels.join(size, "label").where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(float(1 << 30)) * sample / F.col("n"))
    # About 2 * SAMPLE short rows: broadcast, so that no text is dealt out to pick them.
    rows = docs.join(F.broadcast(taken.select("doc_id", "label")), "doc_id").select("doc_id", "label", "text")
    return in_tasks(rows, _clean,
                    "doc_id long, label int, text string, words array<string>, least array<long>")


def train(sample: DataFrame) -> Dictionaries:
    """Dictionaries from ``sample`` rows (doc_id, label, words, least)."""
    rows = sample.select("doc_id", "label", "words", "least")
    first = rows.select("doc_id", F.explode("least").alias("least")).groupBy("least").agg(F.min("doc_id").alias("first"))
    copies = rows.select("doc_id", F.explode("least").alias("least")).join(first, "least") \
        .where("first < doc_id").select("doc_id").distinct()
    single = rows.join(copies, "doc_id", "left_anti").dropDuplicates(["doc_id", "label"])
    total = {r["label"]: r["count"] for r in single.groupBy("label").count().collect()}
    n1, n0 = total.get(1, 0) + 1, total.get(0, 0) + 1
    word = single.select("label", F.explode("words").alias("word")).groupBy("word").agg(
        (F.sum("label") + 0.5).alias("a"), (F.sum(1 - F.col("label")) + 0.5).alias("b")).where("length(word) > 1")
    odds = F.log(F.col("a") / n1) - F.log(F.col("b") / n0)
    error = SURE * F.sqrt(1 / F.col("a") + 1 / F.col("b"))
    word = saved(word.select("word", "a", "b", (odds - error).alias("t"), (-odds - error).alias("o")), "words")

    def best(order: Column, condition: str, limit: int | None = None) -> list[bytes]:
        found = word.where(condition).orderBy(order.desc(), "word")
        return [r["word"].encode() for r in (found.limit(limit) if limit else found).collect()]

    marks = [(r["word"], r["a"], r["t"]) for r in word.where(f"t >= {TOXIC_ODDS}").orderBy(F.desc("t"), "word").collect()]
    toxic = [s.encode() for s in _chosen(marks)]
    word = word.where("not endswith(word, '*')")
    begin = {s.rstrip("*") for s, _, _ in marks}
    ends = [e.encode() for e in _ordinary_ends(word, toxic, n0) if e not in begin]
    return Dictionaries.of(best(F.col("a") / n1 + F.col("b") / n0, f"t < {TOXIC_ODDS} and o < {ODDS}", COMMON // 4),
                           toxic, ends + best(F.col("o"), f"o >= {ODDS}"))


def _ordinary_ends(word: DataFrame, toxic: list[bytes], documents: int) -> list[str]:
    """Beginnings and ends of toxic words that ordinary words have as well. In the
    ordinary dictionary they keep such words from looking toxic."""
    ends = {kind + part for t in (t.decode("utf8", "replace") for t in toxic) for w in (t.rstrip("*"),) for k in range(1, len(w))
            for kind, part in (("<", w[:k]), *((">", w[-k:]) for _ in range(not t.endswith("*")))) if len(part.encode()) >= LEAST_END}
    if not ends:
        return []
    sizes = F.sequence(F.lit(1), F.least(F.length("word") - 1, F.lit(max(map(len, ends)) - 1)))
    parts = F.concat(F.transform(sizes, lambda k: F.concat(F.lit("<"), F.substring("word", F.lit(1), k))),
                     F.transform(sizes, lambda k: F.concat(F.lit(">"), F.substring("word", -k, k))))
    wanted = word.sparkSession.createDataFrame([(e,) for e in sorted(ends)], "part string")
    found = word.where(F.octet_length("word") > LEAST_END).where("length(word) > 1").select(F.explode(parts).alias("part"), "b").join(wanted, "part") \
        .groupBy("part").agg(F.sum(F.col("b") - 0.5).alias("n")).where(F.col("n") >= max(3, documents * END_SHARE)) \
        .orderBy(F.desc("n"), "part").collect()
    return [r["part"][1:] for r in found]


def _calibrated(rows: DataFrame) -> Column:
    """Probability of label 1 as an expression over FEATURES."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    passed = {f"{f}_{t}": (F.col(f) >= t).cast("double") for f, steps in STEPS.items() for t in steps}
    rows = rows.select("label", "weight", *(c.alias(name) for name, c in passed.items()))
    x = VectorAssembler(inputCols=list(passed), outputCol="x").transform(rows)
    fit = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", regParam=1e-3, maxIter=50,
                             standardization=False).fit(x)
    score = F.lit(float(fit.intercept))
    for c, w in zip(passed.values(), fit.coefficients):
        score = score + float(w) * c
    return 1.0 / (1.0 + F.exp(-score))


def scored(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted of every row; ``labels``: (doc_id, label 0/1) to learn from."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.where("label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    taken = saved(_sample(texts, labels, sample), "toxic_sample")
    seen = {r["label"]: r["count"] for r in taken.groupBy("label").count().collect()}
    if len(seen) < 2:
        score = F.lit(float(next(iter(seen), 0.5)))
        return texts.select("doc_id", score.alias("score"), (score >= threshold).cast("int").alias("predicted"))
    distances = _distances(train(taken))
    ddl = ", ".join(f"{f} double" for f in FEATURES)
    known = in_tasks(taken.select("doc_id", "label", "text"), distances, f"doc_id long, label int, {ddl}")
    share = labels.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in share}
    # The sample holds up to as many of either label; the calibration is for their shares in the labels.
    weight = F.when(F.col("label") == 1, n.get(1, 0) / seen[1]).otherwise(n.get(0, 0) / seen[0])
    known = saved(known.withColumn("weight", weight), "toxic_known")
    score = _calibrated(known)
    return in_tasks(texts, distances, f"doc_id long, {ddl}").select(
        "doc_id", score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learned on documents whose remainder of 3 is not 1."""
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    train_rows = labels.where(remainder != 1).select("doc_id", F.col("toxic").alias("label"))
    return scored(docs, train_rows).select("doc_id", (remainder == 1).alias("held_out"), "score", "predicted")
