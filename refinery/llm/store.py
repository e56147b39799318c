"""Shared storage for intermediate tables, and graph components on top of it."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from refinery.session import ship_package


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where nothing is configured
    (tests, a single machine) one is set under the system's temporary folder; on
    a cluster that would not be shared, so there it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="refinery-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage
    is cut, and losing an executor afterwards costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _give_back() -> None:
    """Return freed memory to the system: a Python worker serves task after task, and what the
    stage before has freed would otherwise count beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def _tidy(fn):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        yield from fn(batches)
        _give_back()
    return run


def in_tasks(df: DataFrame, fn, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package importable on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(_tidy(fn), schema)


#: Rows of a few numbers that a task should at least have.
TASK_ROWS = 1 << 18


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to have at most so many rows, in no more tasks than they are worth: hundreds of
    nearly empty shuffle partitions cost more than their rows."""
    tasks = max(1, -(-rows // TASK_ROWS))
    return df.coalesce(tasks) if tasks < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def _compressed(pointers: DataFrame, rows: int) -> DataFrame:
    """The roots of a forest (v, root): every vertex takes over the pointer of the vertex it
    points to, until none moves. A chain of n takes log2(n) joins."""
    while True:
        ahead = pointers.select(F.col("v").alias("root"), F.col("root").alias("next"))
        pointers = saved(few(pointers.select("v", "root").join(ahead, "root").select(
            "v", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), rows), "pointers")
        if pointers.where("moved").isEmpty():
            return pointers.select("v", "root")


def _relabelled(label: DataFrame, step: DataFrame) -> DataFrame:
    return label.join(step.select(F.col("v").alias("root"), F.col("root").alias("next")), "root", "left") \
        .select("v", F.coalesce("next", "root").alias("root"))


def _small_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, root) of a task's edges: every vertex that has edges points to its smallest neighbour, pointers
    are followed by doubling, edges contracted, until none is left."""
    batches = list(batches)
    a, b = (np.concatenate([np.zeros(0, np.int64), *(x.column(c).to_numpy() for x in batches)]) for c in ("a", "b"))
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    own = np.arange(len(names))
    root, a, b = own.copy(), at[:len(a)], at[len(a):]
    while len(a):
        to = np.full(len(names), len(names))
        np.minimum.at(to, a, b)
        np.minimum.at(to, b, a)
        to = np.where(to == len(names), own, to)
        to = np.where(to[to] == own, np.minimum(own, to), to)
        while (to[to] != to).any():
            to = to[to]
        root, a, b = to[root], to[a], to[b]
        a, b = a[a != b], b[a != b]
    least = np.full(len(names), len(names))
    np.minimum.at(least, root, own)
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[least[root]])], names=["v", "root"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b: long, no nulls).

    Returns (v, root), root being the smallest vertex reachable from v. In every round each
    vertex points to its smallest neighbour. The only cycles are of two vertices (the smaller
    of them becomes a root), so at least half of the vertices vanish: rounds are logarithmic
    in the vertices, and so are the joins that follow the pointers to their roots, for long
    chains too. Then the edges are contracted to the roots. All steps are partial aggregates
    and equi-joins whose results are written to the shared folder: a hub is collapsed
    map-side, plans do not grow, and nothing but counts comes to the driver: a round's tables are
    written by as few tasks as their rows are worth (``few``). Once no more than one task's worth of
    edges is left, that task does all remaining rounds: as joins they would take the driver dozens of
    plans, jobs and broadcasts for next to no rows. Self-loops and repeated edges are allowed; an
    empty input gives an empty result.
    """
    edges = saved(few(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        edges.count()), "edges")
    label, vertices = None, 0
    while n := edges.count():
        if n <= TASK_ROWS:
            step = saved(in_tasks(edges.coalesce(1), _small_roots, "v long, root long"), "nearest")
            if label is None:
                return step
            label = _relabelled(label, step)
            break
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(
            edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        nearest = saved(few(both.groupBy("v").agg(F.min("u").alias("m")), 2 * n), "nearest")
        step = _compressed(nearest.join(nearest.select(F.col("v").alias("m"), F.col("m").alias("back")), "m").select(
            "v", F.when(F.col("back") == F.col("v"), F.least("v", "m")).otherwise(F.col("m")).alias("root")), 2 * n)
        if label is None:
            label, vertices = step, 2 * n
        else:
            label = saved(few(_relabelled(label, step), vertices), "labels")
        edges = saved(few(
            edges.join(step.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a")
            .join(step.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b")
            .where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            n), "edges")
    if label is None:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    least = label.groupBy("root").agg(F.min("v").alias("least"))
    return label.join(least, "root").select("v", F.col("least").alias("root"))
