"""Text search without a bundled embedding model, as joins on real terms.

* A term is a run of letters and digits, in lower case; its idf is
  ln((n + 1) / (df + 1)) over the searched items.
* Items and queries become (id, term, weight) rows with length-one weights. The
  score of a pair is the sum of the products over shared terms: an equi-join on
  the term and an aggregate per (query, item), no driver-side query set.
* Items' texts are dealt by item once. Counts, lengths and pair sums then stay where
  the item is: the tables joined on the term (idf, the queries' terms) are broadcast
  while they have at most ``BROADCAST_ROWS`` rows, else Spark joins them by shuffles.
* With broadcast queries a task sums an item's pairs in arrays, and for the k best it
  passes on only pairs that k others of the task do not beat (ties stay).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refinery.operators import search
from refinery.session import saved, ship_package

BROADCAST_ROWS = 1_000_000
CELLS = 1 << 22  # products that a task holds at once, about
DIGITS = 4
TERM_BREAK = r"[^\p{L}\p{N}]+"


def _counts(rows: DataFrame, id_col: str, text_col: str, out: str) -> DataFrame:
    """(out, term, tf)"""
    return rows.select(F.col(id_col).alias(out), F.explode(F.split(F.lower(F.col(text_col)), TERM_BREAK)).alias("term")) \
        .where("term <> ''").groupBy(out, "term").agg(F.count(F.lit(1)).alias("tf"))


def _unit(counts: DataFrame, idf: DataFrame, id_col: str, unseen: float) -> DataFrame:
    """(id, term, w): tf * idf over the row's length. Terms no item has weigh ``unseen``.
    Rows without an id are left out."""
    weighted = counts.where(F.col(id_col).isNotNull()).join(_small(idf), "term", "left") \
        .select(id_col, "term", (F.col("tf") * F.coalesce("idf", F.lit(unseen))).alias("x"))
    length = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(id_col)))
    return weighted.withColumn("length", length).where("length > 0") \
        .select(id_col, "term", (F.col("x") / F.col("length")).alias("w"))


def _small(table: DataFrame) -> DataFrame:
    """A stored table, broadcast unless it is large."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _whole_items(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by item, no item cut, with the first row of each item."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        heads = _heads(rows)
        if len(heads) > 1:
            yield rows.slice(0, heads[-1]), heads[:-1]
        held = rows.slice(heads[-1])
    if held is not None:
        yield held, _heads(held)


def _heads(rows: pa.Table) -> np.ndarray:
    ids = rows.column("item_id").combine_chunks()
    new = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1))
    return np.append(0, np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1)


def _pair_sums(held, k: int | None):
    """Rows (item_id, t, w) sorted by item: sums of products with the queries' weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number, weight, ids = held.value
        n, least = len(ids), np.zeros(len(ids))
        for rows, heads in _whole_items(batches):
            t, w = rows.column("t").to_numpy(), rows.column("w").to_numpy()
            item = rows.column("item_id").combine_chunks()
            size = first[t + 1] - first[t]
            part = np.cumsum(np.add.reduceat(size, heads) + n) // CELLS
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(heads)]
            edge = np.append(heads, len(t))
            for lo, hi in zip(cuts, cuts[1:]):
                a, b = edge[lo], edge[hi]
                own = np.repeat(np.arange(hi - lo), np.diff(edge[lo:hi + 1]))
                each = size[a:b]
                at = np.arange(each.sum()) + np.repeat(first[t[a:b]] - (np.cumsum(each) - each), each)
                total = np.bincount(np.repeat(own, each) * n + number[at], np.repeat(w[a:b], each) * weight[at],
                                    minlength=(hi - lo) * n).reshape(-1, n)
                if k is not None and hi - lo >= k:  # what is lower by more than rounding hides has k better pairs
                    best = np.partition(total, hi - lo - k, axis=0)[hi - lo - k]
                    least = np.maximum(least, best - 2 * 10.0 ** -DIGITS)
                r, q = np.nonzero((total > 0) & (total >= least))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(q)), item.take(pa.array(heads[lo + r])), pa.array(total[r, q])],
                    names=["query_id", "item_id", "score"])
    return run


def _summed(of_items: DataFrame, of_queries: DataFrame, k: int | None) -> DataFrame:
    """Pair sums with the queries' (at most ``BROADCAST_ROWS``) weights held by every task."""
    spark = of_items.sparkSession
    asked = of_queries.toArrow()
    words = asked.column("term").combine_chunks().dictionary_encode()
    ids = asked.column("query_id").combine_chunks().dictionary_encode()
    term = words.indices.to_numpy()
    order = np.argsort(term, kind="stable")
    first = np.searchsorted(term[order], np.arange(len(words.dictionary) + 1))
    held = spark.sparkContext.broadcast((first, ids.indices.to_numpy()[order], asked.column("qw").to_numpy()[order], ids.dictionary))
    numbers = spark.createDataFrame(list(enumerate(words.dictionary.to_pylist())), "t int, term string")
    ship_package(spark)
    schema = T.StructType([of_queries.schema["query_id"], of_items.schema["item_id"], T.StructField("score", T.DoubleType())])
    return of_items.join(F.broadcast(numbers), "term").select("item_id", "t", "w").sortWithinPartitions("item_id") \
        .mapInArrow(_pair_sums(held, k), schema)


def scores(items: DataFrame, queries: DataFrame, item_id: str, item_text: str, query_id: str, query_text: str,
           k: int | None = None) -> DataFrame:
    """(query_id, item_id, score): cosine of every pair that shares a weighted term; with ``k``
    at least of the k best pairs of each query and those that tie with them.

    The queries' terms cut the items' rows before the pair sums; what is shuffled
    is the items' texts, by item, and for the idf one count a task and term.
    """
    n = float(items.count())
    id_ = F.col(item_id)
    tf = _counts(items.where(id_.isNotNull()).select(id_, item_text).repartition(id_), item_id, item_text, "item_id")
    # Items without an id count as one.
    nameless = _counts(items.where(id_.isNull()), item_id, item_text, "item_id")
    idf = saved(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).unionByName(
        nameless.groupBy("term").agg(F.lit(1).cast("long").alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
        .select("term", F.log(F.lit(n + 1) / (F.col("df") + 1)).alias("idf")), "idf")
    of_items = _unit(tf, idf, "item_id", 0.0)
    of_queries = saved(_unit(_counts(queries, query_id, query_text, "query_id"), idf, "query_id", float(_ln(n + 1)))
                       .withColumnRenamed("w", "qw"), "query-terms")
    if of_queries.count() <= BROADCAST_ROWS:
        sums = _summed(of_items, of_queries, k)
    else:
        sums = of_items.join(of_queries, "term").groupBy("query_id", "item_id").agg(F.sum(F.col("w") * F.col("qw")).alias("score"))
    return sums.select("query_id", "item_id", F.round("score", DIGITS).alias("score"))


def _ln(x: float) -> float:
    import math

    return math.log(x)


def tfidf_search(documents: DataFrame, queries: DataFrame, k: int = 5, doc_id: str = "doc_id",
                 text: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """Top-k documents per query text by TF-IDF cosine similarity, best first
    (``rank``); pairs that share no weighted term are not results."""
    search._check_k(k)
    found = scores(documents, queries, doc_id, text, query_id, query_text, k).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("item_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", F.col("item_id").alias("doc_id"), "score", "rank")


def search_index(index: DataFrame, queries: DataFrame, k: int = 5, source: str | None = None,
                 query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """data.search: text queries over a (stored) index, optionally of one source:
    query_id, rank, content, source_id, score, metadata (table and load)."""
    rows = index if source is None else index.where(F.col("source_id") == source)
    best = tfidf_search(rows, queries, k, "doc_id", "content", query_id, query_text)
    return best.join(rows, "doc_id").select(
        "query_id", "rank", "doc_id", "content", "source_id", "score",
        F.create_map(F.lit("table"), F.col("table_name"), F.lit("load"), F.col("load_seq").cast("string")).alias("metadata"))


def rank_by_text(items: DataFrame, id_col: str, text_col: str, queries: DataFrame,
                 query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """The items that share a weighted term with a query, once for each such query, as
    (query_id, items' columns, relevance_score)."""
    found = scores(items, queries, id_col, text_col, query_id, query_text).where("score > 0")
    return items.drop("relevance_score").join(
        found.select("query_id", F.col("item_id").alias(id_col), F.col("score").alias("relevance_score")), id_col)
