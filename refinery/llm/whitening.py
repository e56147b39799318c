"""Whitening of embeddings with the leading components from FEAST contour integrals.

The covariance is summed by tasks in two passes (exact sums first, then products of
centred entries) and merged by a tree of groups; only its dim x dim entries ever meet,
whatever the number of rows. Its leading components come from spectrum slicing:

1. Inertia counts. The factorisation L D L' of the covariance less a shift has as many
   negative eigenvalues of D as there are eigenvalues below the shift (Sylvester). By
   bisection on such counts, the upper end of the spectrum that holds the wanted
   components is cut into intervals of few eigenvalues each, at gaps.
2. FEAST. For each interval, one task integrates the resolvent (z - V)^-1 Y around it:
   a Gauss-Legendre quadrature of complex shifted solves, which projects Y on
   the interval's eigenvectors; Rayleigh-Ritz extracts them; the next Y is what came
   out, until residuals are at rounding level. The number found must be the inertia
   count, else the interval is integrated again with more columns.
3. A last Rayleigh-Ritz step over all intervals' vectors makes them orthogonal across
   intervals.

Inputs: entries are integers floor(scale * c) + shift, so sums are exact; deviations are
computed from integers alone and are exact too (null where one passes 64 bits).

Nulls and ties: rows whose vector is null, empty or holds null or non-finite entries (or
entries beyond 64-bit integers) are dropped. If lengths differ, the most frequent one is
fitted (of equals the smallest); a row of another length comes back once with null
component. Repeated rows count each time. Equal eigenvalues: any orthonormal basis of
their space, the same for all rows. Components without variance (eigenvalue at rounding
level of the largest) cannot be whitened and are left out; if none is left, a row comes
back once with null component. A null vec_id stays null. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refinery.llm.store import in_tasks, saved

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Eigenvalues an interval holds at most (unless they cannot be told apart), nodes of the half contour.
PER_INTERVAL, NODES, ROUNDS = 8, 8, 12
ROWS = 4096  # rows in a block of work
FAN = 64  # groups of tasks whose partial sums are merged first
EPS = float(np.finfo(float).eps)
_LARGEST = (1 << 63) - 1


# --- Inertia -----------------------------------------------------------------------

def below(a: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of symmetric ``a`` below ``shift``: negative eigenvalues of D in
    the Bunch-Kaufman factorisation of a - shift."""
    m = np.array(a, float)
    m[np.diag_indices_from(m)] -= shift
    negative, alpha, n = 0, (1 + 17 ** .5) / 8, len(m)
    k = 0
    while k < n:
        s = m[k:, k:]
        if len(s) == 1:
            return negative + int(s[0, 0] < 0)
        column = np.abs(s[1:, 0])
        r = int(column.argmax()) + 1
        largest = column[r - 1]
        step = 1
        if max(abs(s[0, 0]), largest) == 0:
            k += 1  # an eigenvalue at the shift: not below
            continue
        if abs(s[0, 0]) < alpha * largest:
            other = max(np.abs(np.delete(s[r], r)).max(), 0)
            if abs(s[0, 0]) * other < alpha * largest ** 2:
                if abs(s[r, r]) >= alpha * other:
                    _swap(s, 0, r)
                else:
                    _swap(s, 1, r)
                    step = 2
        pivot = s[:step, :step]
        negative += int((np.linalg.eigvalsh(pivot) < 0).sum())
        if len(s) > step:
            low = s[step:, :step]
            s[step:, step:] -= low @ np.linalg.solve(pivot, low.T)
        k += step
    return negative


def _swap(s: np.ndarray, i: int, j: int) -> None:
    s[[i, j]] = s[[j, i]]
    s[:, [i, j]] = s[:, [j, i]]


def intervals(v: np.ndarray, want: int, per: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues in it), from the top, together holding the ``want`` largest
    eigenvalues. Ends lie where counts do not change nearby, as far as such places exist."""
    n = len(v)
    bound = float(np.abs(v).sum(1).max()) * (1 + 1e-9) + np.finfo(float).tiny
    floor = -bound * 1e-9
    least = bound * 1e-13

    def cut(high: float, over: int, upto: int) -> tuple[float, int]:
        """Largest gap's place below ``high`` with more than ``over`` and, if that can be, at
        most ``upto`` eigenvalues above it."""
        low, top, many = floor, high, n
        while top - low > least:
            at = (low + top) / 2
            k = n - below(v, at)
            if k <= over:
                top = at
            elif k > upto:
                low, many = at, k
            else:
                return _widest(v, at, k, top, low, least), k
        return low, many
    out, high, over = [], bound, 0
    while over < want and high > floor:
        low, k = cut(high, over, min(over + per, max(want, over + 1)))
        out.append((low, high, k - over))
        high, over = low, k
    return out


def _widest(v: np.ndarray, at: float, k: int, top: float, low: float, least: float) -> float:
    """Middle of the stretch around ``at`` in which the count above stays ``k``."""
    n = len(v)
    ends = []
    for away in (top, low):
        near, far = at, away
        while abs(far - near) > max(least, 0.05 * abs(near - at)):
            mid = (near + far) / 2
            near, far = (mid, far) if n - below(v, mid) == k else (near, mid)
        ends.append(near)
    return sum(ends) / 2


# --- FEAST -------------------------------------------------------------------------

def feast(v: np.ndarray, low: float, high: float, count: int, above: int, seed: int = 0) -> np.ndarray:
    """Orthonormal eigenvectors of the eigenvalues in (low, high): ``count`` by inertia, and
    ``above`` lie beyond ``high``. Columns are added until all are found; with as many as
    ``v`` has, Rayleigh-Ritz is exact and the inertia counts tell the ranks to take."""
    n = len(v)
    rng = np.random.default_rng(seed)
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    mid, r = (low + high) / 2, (high - low) / 2
    turns = r * np.exp(1j * np.pi * (1 - nodes) / 2)  # upper half circle; the lower mirrors it
    norm = np.linalg.norm(v, 2)
    width = min(n, count + max(4, count // 2))
    while True:
        y, last = rng.standard_normal((n, width)), np.inf
        for _ in range(ROUNDS):
            q = sum(w / 2 * (t * np.linalg.solve((mid + t) * np.eye(n) - v, y.astype(complex))).real
                    for w, t in zip(weights, turns))
            q, _ = np.linalg.qr(q)
            e, u = np.linalg.eigh(q.T @ v @ q)  # Rayleigh-Ritz
            y = q @ u
            found = (e > low) & (e <= high)
            left = np.linalg.norm(v @ y[:, found] - y[:, found] * e[found], axis=0).max(initial=0)
            if found.sum() == count and (left <= 8 * EPS * norm or left <= 1e-11 * norm and left > last / 2):
                return y[:, found]
            last = left
        if width == n:
            return y[:, ::-1][:, above:above + count]
        width = min(n, 2 * width)


def _feast_tasks(v: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                u = feast(v, r["low"], r["high"], r["n"], r["above"])
                yield pa.RecordBatch.from_pydict({"u": pa.array([u.tobytes()], pa.binary())})
    return run


def eigenpairs(spark, v: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues of symmetric ``v`` (those above rounding level), falling,
    and their eigenvectors as columns. One task an interval."""
    n = len(v)
    if not n or not v.any():
        return np.zeros(0), np.zeros((n, 0))
    cuts, above = [], 0
    for low, high, k in intervals(v, min(want, n)):
        cuts.append((float(low), float(high), int(k), int(above)))
        above += k
    rows = spark.createDataFrame(cuts, "low double, high double, n int, above int").repartition(len(cuts), "above")
    parts = [np.frombuffer(r.u, float).reshape(n, -1) for r in in_tasks(rows, _feast_tasks(v), "u binary").collect()]
    q, _ = np.linalg.qr(np.hstack(parts))
    e, u = np.linalg.eigh(q.T @ v @ q)
    u, e = (q @ u)[:, ::-1], e[::-1]
    keep = min(want, int((e > 8 * n * EPS * e[0]).sum())) if e[0] > 0 else 0
    return e[:keep], u[:, :keep]


# --- Sums over tasks ----------------------------------------------------------------

def integers(batch: pa.RecordBatch, scale: float, shift: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, integer vectors) of the rows that count, by length."""
    column = batch.column("vec")
    edge = np.asarray(column.offsets).astype(np.int64)
    values = column.values
    ok = np.asarray(values.is_valid()) if values.null_count else np.ones(len(values), bool)
    c = np.floor(values.fill_null(0).to_numpy(zero_copy_only=False).astype(float) * scale)
    ok &= np.abs(c) < 2.0 ** 62  # also false for NaN
    bad = np.concatenate([[0], np.cumsum(~ok)])
    size = np.diff(edge)
    use = np.asarray(column.is_valid()) & (size > 0) & (bad[edge[1:]] == bad[edge[:-1]])
    for length in np.unique(size[use]):
        rows = np.flatnonzero(use & (size == length))
        for at in range(0, len(rows), ROWS):
            some = rows[at:at + ROWS]
            yield int(length), some, c[edge[some][:, None] + np.arange(length)].astype(np.int64) + shift


def _sums(scale: float, shift: int):
    """Rows (dim, j, n, hi, lo): per length and dimension the rows and the sum of x, halved at bit 32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows, x in integers(batch, scale, shift):
                yield pa.RecordBatch.from_pydict({
                    "dim": np.full(dim, dim, np.int32), "j": np.arange(dim, dtype=np.int32),
                    "n": np.full(dim, len(rows), np.int64), "hi": (x >> 32).sum(0), "lo": (x & 0xFFFFFFFF).sum(0)})
    return run


def _gram(block: Callable[[np.ndarray], np.ndarray], dim: int, scale: float, shift: int):
    """Rows (i, part, row i of the sum of A'A), A being ``block`` of the task's integer vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            for length, _, x in integers(batch, scale, shift):
                if length == dim:
                    a = block(x)
                    total = a.T @ a if total is None else total + a.T @ a
        if total is not None:
            part = TaskContext.get().partitionId() % FAN
            for i, row in enumerate(total):
                yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "part": pa.array([part], pa.int32()),
                                                  "row": pa.array([row.tolist()], pa.list_(pa.float64()))})
    return run


def _row_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal (i, part), which follow each other, summed."""
    key, total = None, None

    def done():
        return pa.RecordBatch.from_pydict({"i": pa.array([key[0]], pa.int32()), "part": pa.array([key[1]], pa.int32()),
                                           "row": pa.array([total.tolist()], pa.list_(pa.float64()))})
    for batch in batches:
        for i, part, row in zip(*(batch.column(c).to_pylist() for c in ("i", "part")), batch.column("row")):
            row = row.values.to_numpy()
            if (i, part) == key:
                total = total + row
                continue
            if key is not None:
                yield done()
            key, total = (i, part), row
    if key is not None:
        yield done()


def _matrix(rows: DataFrame, fn, size: int) -> np.ndarray:
    ddl = "i int, part int, row array<double>"
    sums = in_tasks(rows, fn, ddl)
    for part in (F.col("part"), F.lit(0)):
        sums = sums.withColumn("part", part).repartition("i", "part").sortWithinPartitions("i", "part")
        sums = in_tasks(sums, _row_sums, ddl)
    out = np.zeros((size, size))
    for r in sums.collect():
        out[r.i] = r.row
    return out


class Model:
    """A fit: rows, sums and eigenpairs. ``parts`` of a block: centred entries, whitened values, deviations."""

    def __init__(self, n: int, sums: list[int], scale: float, shift: int):
        self.n, self.dim, self.scale, self.shift = n, len(sums), scale, shift
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]  # S - n * whole
        self.part = np.array([r / n for r in self.rest])
        self.trace, self.error = 0.0, 0.0
        self.e, self.u = np.zeros(0), np.zeros((self.dim, 0))

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.u / np.sqrt(self.e))

    def with_ones(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([self.whitened(x), np.ones((len(x), 1))])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        d = x - self.whole
        if self.dim * ((int(np.abs(d).max(initial=0)) + 1) * self.n) ** 2 <= _LARGEST:
            return ((d * self.n - np.array(self.rest)) ** 2).sum(1).tolist()
        exact = ((d.astype(object) * self.n - np.array(self.rest, object)) ** 2).sum(1)
        return [int(y) if y <= _LARGEST else None for y in exact]


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))


def fit(df: DataFrame, *, components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT,
        id_col: str = "vec_id", vec_col: str = "embedding") -> Model | None:
    """Leading components of the vectors' covariance; None if no row counts. The driver holds
    a few dim x dim matrices."""
    spark, rows = df.sparkSession, _vectors(df, id_col, vec_col)
    sums = saved(in_tasks(rows, _sums(scale, shift), "dim int, j int, n long, hi long, lo long").groupBy("dim", "j").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("hi", "lo")]), "sums")
    first = sums.where("j = 0").orderBy(F.desc("n"), "dim").first()
    if first is None:
        return None
    held = sorted(sums.where(F.col("dim") == first.dim).collect(), key=lambda r: r.j)
    model = Model(first.n, [(int(r.hi) << 32) + int(r.lo) for r in held], scale, shift)
    v = _matrix(rows, _gram(model.centred, model.dim, scale, shift), model.dim) / model.n
    v = (v + v.T) / 2
    model.trace = float(np.trace(v))
    model.e, model.u = eigenpairs(spark, v, components)
    k = len(model.e)
    if k:
        g = _matrix(rows, _gram(model.with_ones, model.dim, scale, shift), k + 1) / model.n
        model.error = float(np.abs(g[:k, :k] - np.outer(g[:k, k], g[:k, k]) - np.eye(k)).max())
    return model


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _project(model: Model):
    k = len(model.e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, rows, x in integers(batch, model.scale, model.shift):
                m = len(rows)
                ids = batch.column("vec_id").take(pa.array(rows))
                none = length != model.dim or not k
                each = 1 if none else k
                deviation = pa.array([None] * m if length != model.dim else model.deviations(x), pa.int64())
                at = pa.array(np.repeat(np.arange(m), each))
                values = [pa.nulls(m, pa.int32()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())] if none else [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(model.e / model.trace, m))]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), values[0], pa.array(np.full(m * each, model.n, np.int64)), deviation.take(at),
                     values[1], values[2], pa.array(np.full(m * each, model.error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whitened(df: DataFrame, *, components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT,
             id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Per counted row and component (from 1, by falling variance): vec_id, component, n, deviation,
    whitened, explained, identity_error."""
    model = fit(df, components=components, scale=scale, shift=shift, id_col=id_col, vec_col=vec_col)
    if model is None:
        return df.sparkSession.createDataFrame([], _OUT)
    return in_tasks(_vectors(df, id_col, vec_col), _project(model), _OUT)
