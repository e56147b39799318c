"""Approximate vector search: an inverted file with ranked multi-cell probing.

* Cells: centroids by Spark's k-means (cosine) on a sample of at most about ``SAMPLE``
  rows; every row is listed in the cell of its nearest centroid, and long lists are
  dealt into blocks.
* Probing: a query first visits its nearest cells, which gives a lower bound of its
  k-th best score. From the cells' counts of members by their angle to the centroid
  follows how many members of a cell should beat that bound; cells are visited by
  falling promise until the ones left should hold no more than ``missing`` of the k
  neighbours. That is a stop bound for each query: few cells where the data have
  clusters, many where they have none.
* Scoring is a co-grouped join of list blocks with the queries that visit them
  (``blocked.meet``); the queries are not collected. What goes to every task is the
  centroids and counts, bounded by ``MAX_CELLS`` and the vectors' length.

Rows whose vector is null, has null or non-finite entries, length zero or another
dimension than the index are not listed, and such queries find nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refinery.functions import vectors as vx
from refinery.operators import blocked, search
from refinery.session import saved, ship_package

SAMPLE, MAX_CELLS, ITERATIONS = 1 << 16, 1 << 12, 8
BINS = 32  # of the cosine to the centroid
FIRST = 0.05  # share of the rows that the first probes list, at least
PAIRS = 256  # members of a sampled cell whose residuals are compared
_erfc = np.vectorize(math.erfc, otypes=[float])


class Index:
    """Centroids (unit rows), members of each cell by bin (count and mean cosine), and the
    variance of the cosine between two members' residuals."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.cells, self.dim = centroids.shape
        self.count = np.zeros((self.cells, BINS))
        self.cosine = np.zeros((self.cells, BINS))
        self.spread = 1.0 / max(self.dim - 1, 1)

    @property
    def size(self) -> np.ndarray:
        return self.count.sum(1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return x @ self.centroids.T

    def first(self, cosines: np.ndarray, k: int) -> np.ndarray:
        """Cells that a query probes at once: its nearest, until they list enough rows."""
        order = np.argsort(-cosines, kind="stable")
        listed = np.cumsum(self.size[order])
        enough = max(4 * k, FIRST * self.size.sum())
        return order[:int(np.searchsorted(listed, enough)) + 1]

    def promise(self, cosines: np.ndarray, least: float) -> np.ndarray:
        """Members of each cell that should score above ``least``: a member at angle a to the
        centroid, itself at angle t to the query, scores cos t cos a + sin t sin a z, z being
        the cosine of the two residuals, taken as normal."""
        t = np.clip(cosines, -1, 1)[:, None]
        side = np.sqrt(np.maximum((1 - t ** 2) * (1 - self.cosine ** 2) * self.spread, 1e-18))
        return (self.count * 0.5 * _erfc((least - t * self.cosine) / side / math.sqrt(2))).sum(1)

    def later(self, cosines: np.ndarray, least: float, k: int, missing: float) -> np.ndarray:
        """Cells still to be visited after the first probes."""
        promise, size = self.promise(cosines, least), np.maximum(self.size, 1)
        seen = np.zeros(self.cells, bool)
        seen[self.first(cosines, k)] = True
        order = np.argsort(-promise / size, kind="stable")
        order = order[~seen[order]]
        left = promise[order].sum() - (np.cumsum(promise[order]) - promise[order])
        return order[left > missing * k]


def _units(batch: pa.RecordBatch, column: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rows, x = blocked.matrix(batch.column(column), dim)
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.linalg.norm(x, axis=1)
    good = np.isfinite(length) & (length > 0)
    return rows[good], x[good] / length[good][:, None]


def _assign(index: Index, vec_col: str):
    """Rows with cell and cosine to its centroid; other columns stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _units(batch, vec_col, index.dim)
            near = index.nearest(x)
            cell = near.argmax(1) if len(near) else np.zeros(0, np.int64)
            kept = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(cell.astype(np.int32)), pa.array(near[np.arange(len(cell)), cell])],
                names=[*batch.schema.names, "cell", "cosine"])
    return run


def _residuals(index: Index, vec_col: str):
    """Per cell of a sample: pairs of members compared and the sum of their residuals' squared cosines."""
    def run(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        _, x = blocked.matrix(table.column(vec_col).slice(0, PAIRS), index.dim)
        x = x / np.linalg.norm(x, axis=1)[:, None]
        c = index.centroids[cell]
        w = x - (x @ c)[:, None] * c
        length = np.linalg.norm(w, axis=1)
        w = w[length > 1e-9] / length[length > 1e-9][:, None]
        g = (w @ w.T)[np.triu_indices(len(w), 1)]
        return pa.table({"pairs": [len(g)], "total": [float((g ** 2).sum())]})
    return run


def _valid(vectors: DataFrame, vec_col: str) -> DataFrame:
    norm = vx.norm(F.col(vec_col))
    return vectors.where(F.col(vec_col).isNotNull() & (norm > 0) & (norm < float("inf")))


def listed(vectors: DataFrame, index: Index, vec_col: str) -> DataFrame:
    ship_package(vectors.sparkSession)
    return vectors.mapInArrow(_assign(index, vec_col), T.StructType(list(vectors.schema)).add("cell", T.IntegerType()).add("cosine", T.DoubleType()))


def fit(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", cells: int | None = None,
        sample: int = SAMPLE, seed: int = 7) -> Index | None:
    """Index of ``vectors`` (the most frequent length); None if there is nothing to list.
    ``cells`` defaults to twice the root of the number of rows, up to ``MAX_CELLS``."""
    good = _valid(vectors.select(id_col, vec_col), vec_col)
    lengths = good.groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if lengths is None:
        return None
    n, dim = lengths["count"], lengths["d"]
    cells = max(1, min(cells or 2 * math.isqrt(n), MAX_CELLS, n))
    draw = F.pmod(F.xxhash64(F.lit(seed), id_col, vec_col), F.lit(1 << 40)) < int(min(1.0, sample / n) * (1 << 40))
    some = saved(good.where((F.size(vec_col) == dim) & draw).withColumn("unit", vx.unit(F.col(vec_col))), "sample")
    model = KMeans(k=cells, distanceMeasure="cosine", maxIter=ITERATIONS, seed=seed, initMode="random",
                   featuresCol="x").fit(some.select(array_to_vector("unit").alias("x")))
    centroids = np.array(model.clusterCenters())
    index = Index(centroids / np.maximum(np.linalg.norm(centroids, axis=1), 1e-12)[:, None])
    pairs = listed(some, index, vec_col).groupBy("cell").applyInArrow(
        _residuals(index, vec_col), "pairs long, total double").agg(F.sum("pairs").alias("n"), F.sum("total").alias("t")).first()
    if pairs.n:
        index.spread = pairs.t / pairs.n
    step = F.least(F.lit(BINS - 1), F.floor((F.col("cosine") + 1) * (BINS / 2))).cast("int")
    for r in listed(good, index, vec_col).groupBy("cell", step.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.avg("cosine").alias("c")).collect():  # at most cells * BINS rows
        index.count[r.cell, r.bin], index.cosine[r.cell, r.bin] = r.n, min(r.c, 1.0)
    return index


def _visits(index: Index, k: int, missing: float | None):
    """A query's cells: the first ones, or (with its k-th best score so far) the later ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _units(batch, "qv", index.dim)
            near = index.nearest(x)
            cells, listed_rows = [], []
            for i, r in enumerate(rows):
                if missing is None:
                    mine = index.first(near[i], k)
                else:
                    least = batch.column("least")[int(r)].as_py()
                    mine = index.later(near[i], -1.0 if least is None else least, k, missing)
                cells.append(mine.astype(np.int32))
                listed_rows.append(int(index.size[mine].sum()))
            kept = batch.take(pa.array(rows)).select(["query_id", "qv"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(cells, pa.list_(pa.int32())), pa.array(listed_rows, pa.int64())],
                names=["query_id", "qv", "cells", "n_listed"])
    return run


def nearest(vectors: DataFrame, queries: DataFrame, index: Index, *, k: int = 10, missing: float = 0.2,
            id_col: str = "vec_id", vec_col: str = "embedding", query_id_col: str = "query_id",
            query_vec_col: str = "query_vec", keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(query_id, kept columns, score, rank) of the k nearest rows found for each query, and
    (query_id, n_candidates): the rows it was compared with."""
    search._check_k(k)
    ship_package(vectors.sparkSession)
    keep = list(dict.fromkeys([id_col, *(keep or [])]))
    blocks = F.array(*[F.lit(max(1, -(-int(n) // blocked.CORPUS_BLOCK))) for n in index.size])
    per_cell = F.get(blocks, F.col("cell"))
    rows = listed(vectors.select(*keep, vec_col), index, vec_col).withColumn(
        "block", F.pmod(F.xxhash64(id_col, vec_col), per_cell).cast("int"))
    asked = queries.select(F.col(query_id_col).alias("query_id"), F.col(query_vec_col).alias("qv"))
    query_blocks = max(1, -(-asked.count() // blocked.QUERY_BLOCK))

    def probe(df: DataFrame, miss: float | None) -> DataFrame:
        schema = T.StructType(list(asked.schema)).add("cells", T.ArrayType(T.IntegerType())).add("n_listed", T.LongType())
        return saved(df.mapInArrow(_visits(index, k, miss), schema), "visits")

    def compare(visits: DataFrame) -> DataFrame:
        pairs = visits.select("query_id", "qv", F.explode("cells").alias("cell")).select(
            "query_id", "qv", "cell", F.explode(F.sequence(F.lit(0), per_cell - 1)).alias("block"),
            blocked.block_of(query_blocks, F.col("query_id")).alias("part"))
        meets = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))) if query_blocks > 1 \
            else rows.withColumn("part", F.lit(0))
        return blocked.meet(meets, pairs, ["cell", "block", "part"], k, id_col, vec_col, keep)

    first = probe(asked, None)
    early = saved(compare(first), "early")
    bound = blocked.ranked(early, k, id_col).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    later = probe(asked.join(bound, "query_id", "left"), missing)
    found = blocked.ranked(early.unionByName(compare(later)), k, id_col)
    compared = first.select("query_id", "n_listed").unionByName(later.select("query_id", "n_listed")) \
        .groupBy("query_id").agg(F.sum("n_listed").alias("n_candidates"))
    return found, compared


def recall(vectors: DataFrame, queries: DataFrame, *, k: int = 10, missing: float = 0.2, cells: int | None = None,
           id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per query (query_id, query_vec): k_found exact neighbours exist, kth_score of the last
    of them, recall of the index among them, and n_candidates compared."""
    index = fit(vectors, id_col=id_col, vec_col=vec_col, cells=cells)
    exact = saved(search.search_batch(vectors, queries, k=k, id_col=id_col, vec_col=vec_col, keep=[id_col]), "exact")
    wanted = exact.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_neighbours"), F.min("score").alias("kth_score"))
    if index is None:
        return wanted.select("*", F.lit(None).cast("double").alias("recall"), F.lit(0).cast("long").alias("n_candidates"))
    found, compared = nearest(vectors, queries, index, k=k, missing=missing, id_col=id_col, vec_col=vec_col)
    hits = exact.join(found.select("query_id", id_col, F.lit(1).alias("hit")), ["query_id", id_col], "left") \
        .groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    return wanted.join(hits, "query_id").join(compared, "query_id", "left") \
        .select("query_id", "n_neighbours", "kth_score", "recall", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))
