"""data.search: vector index upsert/delete and top-k similarity search.

* Single query: the query vector is a literal array column, so scoring is a
  plain projection and top-k is TakeOrderedAndProject (per-partition top-k,
  then a merge) — no join.
* Batch of queries: blocks of corpus rows meet blocks of queries in a co-grouped
  shuffle (``blocked``); neither side is collected or broadcast, and only k rows
  per query and block go on to the final per-query top-k.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refinery.functions import vectors as vx
from refinery.operators import blocked
from refinery.session import ship_package

MAX_RESULTS = 100


def document_id(source_id, table, record):
    """md5 of 'source:table:record': identical records of a table share an id."""
    return F.md5(F.concat_ws(":", source_id, table, record))


def index_records(df: DataFrame, source_id, table: str, content_col: str, load_seq: int,
                  record_cols: list[str] | None = None) -> DataFrame:
    """Index rows of one load: (doc_id, source_id, table_name, content, load_seq). The
    id covers the whole record (``record_cols``, default all columns) as JSON."""
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in record_cols or df.columns]), {"ignoreNullFields": "false"})
    source = F.lit(source_id) if isinstance(source_id, str) else source_id
    return df.select(document_id(source, F.lit(table), record).alias("doc_id"), source.alias("source_id"),
                     F.lit(table).alias("table_name"), F.col(content_col).alias("content"), F.lit(load_seq).alias("load_seq"))


def upsert(index: DataFrame, *loads: DataFrame) -> DataFrame:
    """Union the loads; per doc_id the row with the highest load_seq wins
    (``max(struct(load_seq, ...))`` — partial aggregate, skew-safe)."""
    allrows = index
    for ld in loads:
        allrows = allrows.unionByName(ld)
    latest = allrows.groupBy("doc_id").agg(F.max(F.struct("load_seq", "source_id", "table_name", "content")).alias("r"))
    return latest.select("doc_id", "r.source_id", "r.table_name", "r.content", "r.load_seq")


def write_index(index: DataFrame, path: str) -> None:
    """Persist partitioned by source, so source filters prune whole folders. An index that is
    loaded again and again while it is read is kept by ``snapshots``."""
    index.write.mode("overwrite").partitionBy("source_id").parquet(path)


def delete_source(index: DataFrame, source_id: str) -> tuple[DataFrame, DataFrame]:
    """(index without the source's vectors, one-row count of what was removed)."""
    keep = index.where(~F.col("source_id").eqNullSafe(F.lit(source_id)))
    removed = index.agg(
        F.sum(F.when(F.col("source_id").eqNullSafe(F.lit(source_id)), 1).otherwise(0)).cast("bigint").alias("deleted"),
        F.sum(F.when(F.col("source_id").eqNullSafe(F.lit(source_id)), 0).otherwise(1)).cast("bigint").alias("remaining"))
    return keep, removed


def _check_k(k: int) -> int:
    if not 1 <= k <= MAX_RESULTS:
        raise ValueError(f"k must be in 1..{MAX_RESULTS}")
    return k


def search_vector(corpus: DataFrame, query: list[float], k: int = 10, id_col: str = "vec_id",
                  vec_col: str = "embedding", where=None) -> DataFrame:
    """Top-k rows by round(cosine similarity, 4) desc, id asc. ``where`` is a
    metadata filter applied before scoring (pushed to the scan)."""
    _check_k(k)
    q = F.array(*[F.lit(float(x)) for x in query])
    qn = float(np.linalg.norm(np.asarray(query, dtype=np.float64)))
    rows = corpus.where(where) if where is not None else corpus
    scored = rows.withColumn("score", vx.similarity_score(F.col(vec_col), q, F.lit(qn)))
    return scored.where(F.col("score").isNotNull()).orderBy(F.col("score").desc(), F.col(id_col)).limit(k)


def search_batch(corpus: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
                 vec_col: str = "embedding", query_id_col: str = "query_id",
                 query_vec_col: str = "query_vec", keep: list[str] | None = None) -> DataFrame:
    """Top-k per query of a set of query vectors, by blocks (see ``blocked``).

    Every block of queries meets every block of corpus rows as one group of a co-grouped
    shuffle, and k rows a query and group go on to the final window. ``id_col`` tells corpus
    rows apart. Vectors that are null, hold nulls or have another length than the query's
    are no results.
    """
    _check_k(k)
    ship_package(corpus.sparkSession)
    keep = list(keep or [c for c in corpus.columns if c != vec_col])
    if id_col not in keep:
        keep.insert(0, id_col)
    asked = queries.select(F.col(query_id_col).alias("query_id"), F.col(query_vec_col).alias("qv"))
    each = asked.groupBy("query_id").count().agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most")).first()
    if (each.most or 0) > 1:
        raise ValueError(f"{query_id_col} must be unique: results are told apart by it")
    row_blocks = max(1, -(-corpus.count() // blocked.CORPUS_BLOCK))
    query_blocks = max(1, -(-each.n // blocked.QUERY_BLOCK))

    def dealt(df: DataFrame, own: str, of: F.Column, blocks: int, other: str, others: int) -> DataFrame:
        df = df.withColumn(own, blocked.block_of(blocks, of) if blocks > 1 else F.lit(0))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))) if others > 1 else F.lit(0))

    rows = dealt(corpus.select(*keep, vec_col), "_rows", F.col(id_col), row_blocks, "_queries", query_blocks)
    asked = dealt(asked, "_queries", F.col("query_id"), query_blocks, "_rows", row_blocks)
    return blocked.ranked(blocked.meet(rows, asked, ["_rows", "_queries"], k, id_col, vec_col, keep), k, id_col)


def label_exemplars(corpus: DataFrame, label_col: str = "label", id_col: str = "vec_id",
                    vec_col: str = "embedding") -> DataFrame:
    """One query vector per label: the vector with the smallest id (bounded by
    the number of labels; ``min_by`` is a partial aggregate)."""
    return corpus.groupBy(label_col).agg(F.min_by(vec_col, id_col).alias("query_vec")) \
        .withColumnRenamed(label_col, "query_id")
