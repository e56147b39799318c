"""Quality classifier: a sparse ensemble of rules over text statistics.

1. ``statistics`` reduces every whole text to about twenty numbers, linear in its
   length, in batches.
2. ``fit`` grows a small random forest on labelled rows, takes every path from a
   root as a rule (a conjunction of bounds on statistics), and fits a logistic
   regression with an L1 penalty on the rules' truth values; rules of weight zero
   drop out.
3. The rules that stay are compiled into one Spark column expression, so scoring
   is a projection.

Labelled rows are read up to ``SAMPLE`` rows: beyond it, rows are taken by a hash
of their id. Everything else covers all rows.

Nulls and odd inputs: a null text has the statistics of an empty one. Labels that
are null or belong to no document are ignored; a document with several labels
counts once for each. Without labels of both classes the score is the share of
label 1 (0.5 without any). Repeated rows are scored alike; an empty table gives
an empty result. Columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refinery.llm.store import in_tasks, saved
from refinery.llm.textbatch import Words, pieces, utf8

SAMPLE = 20_000
TREES, DEPTH, PENALTY, SEED = 16, 3, 0.002, 7

_CLASS_NAMES = ("space", "newline", "lower", "upper", "digit", "stop", "shout", "quote", "symbol", "other_ascii", "wide")
_CLASSES = np.full(256, 9, np.uint8)
for _i, _chars in enumerate((b" \t", b"\n\r", bytes(range(0x61, 0x7B)), bytes(range(0x41, 0x5B)), b"0123456789",
                             b".,;:", b"!?", b"'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~")):
    _CLASSES[list(_chars)] = _i
_CLASSES[0x80:] = 10
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False

FEATURES = ("n_bytes", "n_words", "word_bytes", "longest_word", "distinct_words", "short_words", "capital_words",
            "upper_words", "symbol_ends", "lone_symbols", "n_lines", "distinct_lines", "line_words",
            *(f"share_{c}" for c in _CLASS_NAMES))


def _per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _distinct(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Distinct values of ``h`` in each document (``doc`` ascending)."""
    out = np.zeros(docs, np.int64)
    edge = np.searchsorted(doc, np.arange(docs + 1))
    for i in np.flatnonzero(np.diff(edge)):
        own = np.sort(h[edge[i]:edge[i + 1]])
        out[i] = 1 + (own[1:] != own[:-1]).sum()
    return out


_KEYS = ("doc_id", "key_a", "key_b")


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        data, offsets = utf8(batch.column("text"))
        docs = batch.num_rows
        doc = np.repeat(np.arange(docs), np.diff(offsets))
        classes = np.bincount(doc * 16 + _CLASSES[data], minlength=docs * 16).reshape(docs, 16)[:, :len(_CLASS_NAMES)]
        del doc
        n_bytes = np.diff(offsets).astype(float)
        words = Words(batch.column("text"))
        n = np.diff(words.bounds).astype(float)
        size = words.ends - words.starts
        first, last = _CLASSES[data[words.starts]], _CLASSES[data[words.ends - 1]]
        second = _CLASSES[data[np.minimum(words.starts + 1, len(data) - 1)]] if len(words) else first
        lines = Words(batch.column("text"), keep=_NOT_NEWLINE)
        n_lines = np.diff(lines.bounds).astype(float)
        longest = np.zeros(docs)
        np.maximum.at(longest, words.doc, size)
        some, some_lines = np.maximum(n, 1), np.maximum(n_lines, 1)
        columns = [
            n_bytes, n, _per_doc(size, words.bounds) / some, longest,
            _distinct(words.hashes(), words.doc, docs) / some,
            _per_doc(size <= 3, words.bounds) / some,
            _per_doc((first == 3) & (size > 1) & (second != 3), words.bounds) / some,
            _per_doc((first == 3) & (size > 1) & (second == 3), words.bounds) / some,
            _per_doc((last == 8) | (last == 6), words.bounds) / some,
            _per_doc((first == 8) & (size == 1), words.bounds) / some,
            n_lines, _distinct(lines.hashes(), lines.doc, docs) / some_lines, n / some_lines,
            *(classes[:, i] / np.maximum(n_bytes, 1) for i in range(len(_CLASS_NAMES)))]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in _KEYS), *(pa.array(np.asarray(c, np.float64)) for c in columns)],
            names=[*_KEYS, *FEATURES])


def text_keys(text: Column) -> list[Column]:
    """Two hashes of a text: rows with the same text have the same keys, whatever their ids."""
    return [F.xxhash64(text).alias("key_a"), F.xxhash64(F.lit(1), text).alias("key_b")]


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the text's keys and FEATURES (doubles) for every row."""
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), *text_keys(text))
    return in_tasks(texts, _statistics, "doc_id long, key_a long, key_b long, " + ", ".join(f"{f} double" for f in FEATURES))


Rule = tuple[tuple[str, float, float], ...]  # (statistic, above, at most), sorted


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability of label 1 as an expression over the statistics."""
        total = " + ".join([f"{self.bias!r}D", *(f"if({_sql(r)}, {w!r}D, 0D)" for r, w in self.rules)])
        return F.expr(f"1D / (1D + exp(-({total})))")


def _sql(rule: Rule) -> str:
    bounds = []
    for name, above, most in rule:
        if above > -math.inf:
            bounds.append(f"{name} > {float(above)!r}D")
        if most < math.inf:
            bounds.append(f"{name} <= {float(most)!r}D")
    return " and ".join(bounds)


def condition(rule: Rule) -> Column:
    return F.expr(_sql(rule))


def _paths(node, held: dict[str, tuple[float, float]], out: set[Rule]) -> None:
    if held:
        out.add(tuple(sorted((f, lo, hi) for f, (lo, hi) in held.items())))
    if node.getClass().getSimpleName() != "InternalNode":
        return
    name, cut = FEATURES[node.split().featureIndex()], node.split().threshold()
    lo, hi = held.get(name, (-math.inf, math.inf))
    _paths(node.leftChild(), held | {name: (lo, min(hi, cut))}, out)
    _paths(node.rightChild(), held | {name: (max(lo, cut), hi)}, out)


def fit(stats: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> RuleModel:
    """``labels``: (doc_id, label 0/1), the rows to learn from."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    labels = labels.where("label is not null").select("doc_id", F.col("label").cast("double").alias("label"))
    n = labels.count()
    if n > sample:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    rows = saved(stats.join(labels, "doc_id").select("label", *FEATURES), "labelled")
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        share = next(iter(seen), 0.5)
        return RuleModel({0.0: -20.0, 0.5: 0.0}.get(share, 20.0), ())
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows).coalesce(1).sortWithinPartitions(
        *FEATURES, "label")
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED,
                                    subsamplingRate=0.7, featureSubsetStrategy="onethird").fit(rows)
    found: set[Rule] = set()
    for tree in forest.trees:
        _paths(tree._java_obj.rootNode(), {}, found)
    rules = sorted(found)
    if not rules:
        share = seen[1.0] / sum(seen.values())
        return RuleModel(math.log(share / (1 - share)), ())
    truth = rows.select("label", F.expr(f"array({', '.join(f'if({_sql(r)}, 1D, 0D)' for r in rules)})").alias("t"))
    from pyspark.ml.functions import array_to_vector

    truth = saved(truth.select("label", array_to_vector("t").alias("x")), "rules")
    lasso = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=PENALTY,
                               standardization=False, maxIter=40, tol=1e-5).fit(truth)
    weights = lasso.coefficients.toArray()
    return RuleModel(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, weights) if w != 0.0))


def scored(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the text's keys, score, predicted for every row of ``docs``."""
    stats = saved(statistics(docs), "statistics")
    model = fit(stats, labels, sample=sample)
    return stats.select(*_KEYS, model.score().alias("score")) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_poor(docs: DataFrame, labels: DataFrame, *, threshold: float, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``: rows without an id, and rows that
    share one, are judged by their own texts."""
    poor = scored(docs, labels, threshold=threshold, sample=sample).where("predicted = 0").select("key_a", "key_b").distinct()
    a, b = text_keys(docs["text"])
    return docs.join(poor, (a == poor["key_a"]) & (b == poor["key_b"]), "left_anti")


def remainder(of: int) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learned on documents whose remainder of 4 is not 2."""
    train = labels.where(remainder(4) != 2).select("doc_id", F.col("quality").alias("label"))
    return scored(docs.select("doc_id", "text"), train).select(
        "doc_id", (remainder(4) == 2).alias("held_out"), "score", "predicted")
