"""Top-k similarity of query vectors against a corpus, as a join of bounded blocks.

Corpus rows and query rows are dealt into blocks; a pair of blocks that have to meet is
one group of a co-grouped shuffle and is scored with one matrix product. Neither side is
collected or broadcast, both sides of a group are bounded by the block sizes, and a
group returns only the k best rows of each of its queries.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORPUS_BLOCK, QUERY_BLOCK = 1 << 14, 1 << 10
SCORE_BLOCK = 1 << 22  # numbers of a score matrix held at once


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, float64 matrix) of the vectors of ``dim`` numbers without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.int64), np.zeros((0, dim))
    edge = np.asarray(column.offsets).astype(np.int64)
    bad = np.concatenate([[0], np.cumsum(np.asarray(column.values.is_null()))])
    use = np.asarray(column.is_valid()) & (np.diff(edge) == dim) & (bad[edge[1:]] == bad[edge[:-1]])
    rows = np.flatnonzero(use)
    values = column.values.fill_null(0).to_numpy(zero_copy_only=False).astype(float)
    return rows, values[edge[rows][:, None] + np.arange(dim)]


def _best(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest numbers of each column, NaN never; of equals the first rows."""
    kept = np.where(np.isnan(sims), -np.inf, sims)
    if len(kept) > k:
        least = np.partition(kept, len(kept) - k, axis=0)[len(kept) - k]
    else:
        least = np.full(kept.shape[1], -np.inf)
    col, row = np.nonzero((kept >= least).T & (kept > -np.inf).T)
    order = np.lexsort((row, -kept[row, col], col))
    row, col = row[order], col[order]
    place = np.arange(len(col)) - np.searchsorted(col, col)
    return row[place < k], col[place < k]


def top_k(k: int, id_col: str, vec_col: str, keep: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For a group (corpus rows, queries): the k best rows of each query by rounded cosine, ties by id."""
    def score(rows: pa.Table, queries: pa.Table) -> pa.Table:
        queries = queries.combine_chunks()
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(id_col, "ascending")], null_placement="at_start"))
        parts = []
        sizes = pc.list_value_length(queries.column("qv")).drop_null().unique().to_pylist() if len(queries) else []
        for dim in sizes:
            at, x = matrix(rows.column(vec_col), dim)
            which, y = matrix(queries.column("qv"), dim)
            with np.errstate(divide="ignore", invalid="ignore"):
                norm = np.linalg.norm(x, axis=1)
            step = max(1, SCORE_BLOCK // max(len(x), 1))
            for q in range(0, len(y), step):
                some = y[q:q + step]
                with np.errstate(divide="ignore", invalid="ignore"):
                    sims = np.round(x @ some.T / np.outer(norm, np.linalg.norm(some, axis=1)), 4)
                row, col = _best(sims, k)
                parts.append(rows.select(keep).take(pa.array(at[row]))
                             .append_column("query_id", queries.column("query_id").take(pa.array(which[q + col])))
                             .append_column("score", pa.array(sims[row, col])))
        if parts:
            return pa.concat_tables(parts)
        none = rows.select(keep).slice(0, 0)
        return none.append_column("query_id", queries.column("query_id").slice(0, 0)).append_column("score", pa.array([], pa.float64()))
    return score


def group_schema(corpus: DataFrame, keep: list[str], query_id: T.DataType) -> T.StructType:
    return T.StructType([corpus.schema[c] for c in keep]).add("query_id", query_id).add("score", "double")


def meet(rows: DataFrame, queries: DataFrame, keys: list[str], k: int, id_col: str, vec_col: str,
         keep: list[str]) -> DataFrame:
    """Rows and queries (query_id, qv) that agree on ``keys`` meet: per group the best of each query."""
    schema = group_schema(rows, keep, queries.schema["query_id"].dataType)
    return rows.select(*keys, *keep, vec_col).groupBy(*keys).cogroup(
        queries.select(*keys, "query_id", "qv").groupBy(*keys)).applyInArrow(top_k(k, id_col, vec_col, keep), schema)


def ranked(found: DataFrame, k: int, id_col: str) -> DataFrame:
    """The k best of each query over all groups, with their rank."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_col))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def block_of(n: int, *columns: Column) -> Column:
    """A block number from 0 to n - 1 by a hash of ``columns``."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
