"""Embedding near-duplicates by an inverted multi-index.

Vectors are scaled to length one and cut into halves. Each half has a codebook of
its own (k-means on a bounded sample), and the product of the two is a grid of
cells. A vector lives in the cell of its nearest codes. To search, a vector visits
cells by the multi-sequence rule: both lists of codes are sorted by how far the
vector would have to move to enter a code's region, and pairs are visited in the
order of their summed squares up to a radius. The radius is calibrated: pairs at
exactly the link threshold are simulated from the sample, and the radius is the
smallest at which ``RECALL`` of them are found. Candidates are then verified by
cosine in double precision, so no link below the threshold is reported.

Equal vectors are one vertex with a weight. A crowded cell is cut into blocks of
about ``BLOCK`` residents and visitors, and pairs of blocks are separate groups, so
no group grows with a cell; links are counted inside a group (never written as
pairs), and a group passes on at most one edge per vector for the components.

Nulls: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing: n_links 0, component_id is the own id, kept. Vectors of another
length than most are compared with those of the same length, all with all in
blocks. Rows that share a vec_id are one vertex, and the links of their vectors
add up. A null vec_id gets a null component and is not kept; its vector counts as
a partner of equal vectors only. Empty tables give empty results; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refinery.llm.store import components, in_tasks, saved

SAMPLE_ROWS, SAMPLE_FLOATS = 20_000, 8_000_000
RECALL = 0.98
BLOCK = 256
MAX_CODES = 1024
ROUNDS = 12


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, vec): components as doubles, or null where a vector cannot link."""
    for batch in batches:
        column = batch.column("vec")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        out = []
        for v in column:
            if v.is_valid and len(v.values) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                out.append(x.tobytes() if np.isfinite(x).all() and np.abs(x).max() > 0 else None)
            else:
                out.append(None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "vec"])


def unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        order = np.argsort(own, kind="stable")
        some = count > 0
        sums = np.add.reduceat(x[order], (np.cumsum(count) - count)[some])
        centres[some] = sums / count[some][:, None]
    return np.unique(centres, axis=0)


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1), 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([_squares(x[i:i + 4096], centres).argmin(axis=1) for i in range(0, len(x), 4096)])


class Grid:
    """Two codebooks and the radius of a search."""

    def __init__(self, sample: np.ndarray, codes: int, threshold: float, recall: float):
        self.dims = sample.shape[1]
        self.half = max(1, self.dims // 2)
        rng = np.random.default_rng(20240501)
        halves = (sample[:, :self.half], sample[:, self.half:])
        self.books = [kmeans(h, codes, rng) if h.shape[1] else np.zeros((1, 0)) for h in halves]
        # Simulated partners at the threshold itself: the worst case that must be found.
        x = sample[rng.choice(len(sample), min(len(sample), 4000), replace=False)]
        away = rng.standard_normal(x.shape)
        away -= (away * x).sum(axis=1, keepdims=True) * x
        size = np.sqrt((away * away).sum(axis=1, keepdims=True))
        y = threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * away / np.maximum(size, 1e-300)
        at = self.home(y)
        effort = sum(m[np.arange(len(x)), c] ** 2 for m, c in zip(self.margins(x), at))
        self.radius = float(np.quantile(effort, recall)) + 1e-12

    def home(self, x: np.ndarray) -> list[np.ndarray]:
        return [nearest(x[:, a:b], book) for (a, b), book in
                zip(((0, self.half), (self.half, self.dims)), self.books)]

    def margins(self, x: np.ndarray) -> list[np.ndarray]:
        """Distance of each vector's halves to the regions of all codes (to the plane
        between a code and the nearest one)."""
        out = []
        for (a, b), book in zip(((0, self.half), (self.half, self.dims)), self.books):
            d = _squares(x[:, a:b], book)
            best = d.argmin(axis=1)
            apart = np.sqrt(_squares(book, book))[best]
            m = (d - d[np.arange(len(d)), best][:, None]) / (2 * np.maximum(apart, 1e-12))
            m[np.arange(len(d)), best] = 0.0
            out.append(m)
        return out

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) visited, nearest cells first for each row by the multi-sequence
        rule, side by side for all rows: the k-th code of one list is combined with
        ever further codes of the other while the sum is within the radius."""
        lists = []
        for m in self.margins(x):
            order = np.argsort(m, axis=1, kind="stable")
            lists.append((order, np.take_along_axis(m, order, axis=1) ** 2))
        (code1, cost1), (code2, cost2) = lists
        rows, cells, costs = [], [], []
        for a in range(code1.shape[1]):
            left = np.flatnonzero(cost1[:, a] <= self.radius)
            if not len(left):
                break
            for b in range(code2.shape[1]):
                left = left[cost1[left, a] + cost2[left, b] <= self.radius]
                if not len(left):
                    break
                rows.append(left)
                cells.append(code1[left, a].astype(np.int64) * len(self.books[1]) + code2[left, b])
                costs.append(cost1[left, a] + cost2[left, b])
        rows, cells, costs = map(np.concatenate, (rows, cells, costs))
        order = np.lexsort((costs, rows))
        return rows[order], cells[order]


def _cells(held):
    """Each vector as a resident (kind 0) of its cell and a visitor (kind 1) of all it visits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid: Grid = held.value
        for big in batches:
            for at in range(0, big.num_rows, 500):
                batch = big.slice(at, 500)
                raw = batch.column("vec").to_pylist()
                dims = np.array([len(v) // 8 for v in raw])
                own = np.flatnonzero(dims == grid.dims)
                home = -dims.astype(np.int64)  # a vector of another length: the cell of its length
                visits = [[int(h)] for h in home]
                if len(own):
                    rows, cells = grid.visits(unit([raw[i] for i in own]))
                    edge = np.searchsorted(rows, np.arange(len(own) + 1))
                    for k, i in enumerate(own):
                        visits[i] = cells[edge[k]:edge[k + 1]].tolist()
                        home[i] = visits[i][0]
                count = [len(v) for v in visits]
                n = len(raw)
                pick = np.concatenate([np.arange(n), np.repeat(np.arange(n), count)])
                cell = np.concatenate([home, np.array([c for v in visits for c in v], np.int64)])
                kind = np.repeat(np.array([0, 1], np.int8), [n, sum(count)])
                base = pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("weight"), batch.column("vec"), pa.array(home),
                     pa.array(visits, pa.list_(pa.int64()))], names=["id", "weight", "vec", "home", "visits"])
                taken = base.take(pa.array(pick))
                none = pa.array([None] * len(pick), pa.list_(pa.int64()))
                resident = pa.array(kind == 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(kind), *taken.columns[:4],
                     pa.compute.if_else(resident, taken.column("visits"), none)],
                    names=["cell", "kind", *taken.schema.names[:4], "visits"])
    return run


_CELL_DDL = "cell long, kind tinyint, id long, weight long, vec binary, home long, visits array<long>"


def _spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest position reachable for each of n positions by links (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, before[i])
        label = label[label]
        if (label == before).all():
            return label


def _verify(threshold: float):
    """Groups (cell, rb, vb): a block of residents against one of visitors. Out:
    (a, b, n): n links of vertex a with b null, or an edge a - b with n null."""
    def compare(t: pa.Table) -> pa.RecordBatch | None:
        kind = t.column("kind").to_numpy()
        ids, weight = t.column("id").to_numpy(), t.column("weight").to_numpy()
        home, cell = t.column("home").to_numpy(), t.column("cell")[0].as_py()
        res, vis = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        if not len(res) or not len(vis):
            return None
        vec = t.column("vec")
        x = unit([vec[int(i)].as_py() for i in vis])
        y = unit([vec[int(i)].as_py() for i in res])
        v, r = np.nonzero(x @ y.T >= threshold)
        keep = ids[vis[v]] != ids[res[r]]
        v, r = vis[v[keep]], res[r[keep]]
        # A pair that finds each other both ways counts where its smaller id visits.
        listed = [np.asarray(t.column("visits")[int(i)].as_py(), np.int64) for i in res]
        place = np.zeros(t.num_rows, np.int64)
        place[res] = np.arange(len(res))
        names, number = np.unique(np.concatenate([*listed, home[vis]]), return_inverse=True)
        owner = np.repeat(np.arange(len(res)), [len(x) for x in listed])
        known = np.unique(owner * len(names) + number[:len(owner)])
        of_home = np.zeros(t.num_rows, np.int64)
        of_home[vis] = number[len(owner):]
        both = np.isin(place[r] * len(names) + of_home[v], known)
        keep = ~both | (ids[v] < ids[r])
        v, r = v[keep], r[keep]
        if not len(v):
            return None
        n = np.bincount(v, weight[r], t.num_rows) + np.bincount(r, weight[v], t.num_rows)
        some = np.flatnonzero(n)
        label = _spanning(t.num_rows, v, r)
        edge = np.flatnonzero(label != np.arange(t.num_rows))
        a = np.concatenate([ids[some], ids[edge]])
        b = np.concatenate([np.zeros(len(some), np.int64), ids[label[edge]]])
        first = np.arange(len(a)) < len(some)
        total = np.concatenate([n[some].astype(np.int64), np.zeros(len(edge), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=first), pa.array(total, mask=~first)],
                                          names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("cell", "rb", "vb")])
            cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                now = tuple(k[:, lo])
                if held and now != last and (out := compare(pa.Table.from_batches(held))) is not None:
                    yield out
                held = (held if now == last else []) + [batch.slice(lo, hi - lo)]
                last = now
        if held and (out := compare(pa.Table.from_batches(held))) is not None:
            yield out
    return run


def fit(reps: DataFrame, threshold: float, recall: float, sample_rows: int, sample_floats: int) -> Grid | None:
    """Codebooks and radius from a sample of the commonest vector length."""
    sizes = reps.groupBy((F.octet_length("vec") / 8).cast("int").alias("dims")).count() \
        .orderBy(F.desc("count"), "dims").limit(1).collect()
    if not sizes:
        return None
    dims, n = sizes[0]["dims"], sizes[0]["count"]
    take = max(1, min(sample_rows, sample_floats // dims))
    rows = reps.where(F.octet_length("vec") == dims * 8)
    if n > take:
        rows = rows.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) <= int((1 << 30) * take / n))
    sample = unit([r["vec"] for r in rows.select("vec").limit(2 * take).collect()] or [np.ones(dims).tobytes()])
    return Grid(sample, int(np.clip(round((n / 64) ** 0.5), 1, MAX_CODES)), threshold, recall)


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.95, recall: float = RECALL, block: int = BLOCK,
                    id_col: str = "vec_id", vec_col: str = "embedding", sample_rows: int = SAMPLE_ROWS,
                    sample_floats: int = SAMPLE_FLOATS) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    rows = saved(in_tasks(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")),
                          _vectors, "vec_id long, vec binary"), "vectors")
    classes = saved(rows.where("vec is not null").groupBy("vec").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("weight")), "classes")
    reps = classes.where("id is not null")
    grid = fit(reps, threshold, recall, sample_rows, sample_floats)
    if grid is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    cells = saved(in_tasks(reps.select("id", "weight", "vec"), _cells(spark.sparkContext.broadcast(grid)), _CELL_DDL),
                  "cells")
    crowd = cells.groupBy("cell").agg(
        F.greatest(F.lit(1), F.ceil(F.sum((F.col("kind") == 0).cast("int")) / block)).cast("int").alias("res"),
        F.greatest(F.lit(1), F.ceil(F.sum((F.col("kind") == 1).cast("int")) / block)).cast("int").alias("vis"),
        F.sum((F.col("kind") == 0).cast("int")).alias("n")).where("n > 0")
    own = F.pmod(F.xxhash64("id"), F.when(F.col("kind") == 0, F.col("res")).otherwise(F.col("vis")).cast("long")).cast("int")
    resident = F.col("kind") == 0
    dealt = cells.join(crowd, "cell").withColumn("own", own) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(resident, F.col("vis")).otherwise(F.col("res")) - 1))) \
        .select("cell", F.when(resident, F.col("own")).otherwise(F.col("other")).alias("rb"),
                F.when(resident, F.col("other")).otherwise(F.col("own")).alias("vb"),
                "kind", "id", "weight", "vec", "home", "visits")
    found = saved(in_tasks(dealt.repartition("cell", "rb", "vb").sortWithinPartitions("cell", "rb", "vb"),
                           _verify(threshold), "a long, b long, n long"), "links")
    roots = components(found.where("b is not null").select("a", "b"))
    links = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    label = classes.join(links.withColumnRenamed("a", "id"), "id", "left") \
        .join(roots.select(F.col("v").alias("id"), "root"), "id", "left") \
        .select("vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                F.coalesce("root", "id").alias("root"))
    out = rows.join(label, "vec", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec").isNull() | F.col("vec_id").isNull(), F.col("vec_id")).otherwise(F.col("root")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
