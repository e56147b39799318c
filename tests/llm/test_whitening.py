"""Whitening against exact integers and a dense eigensolver."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from refinery.llm import whitening


def matrix(e, seed=0):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(len(e), len(e))))
    v = q * np.array(e, float) @ q.T
    return (v + v.T) / 2


SPECTRA = {
    "spread": np.geomspace(1e6, 1e-3, 40), "equal": np.ones(20), "pairs": np.repeat(np.arange(1, 21), 2),
    "cluster": np.concatenate([1 + 1e-9 * np.arange(12), [5, 7, 7 + 1e-12]]), "rank": np.concatenate([[9, 4, 4], np.zeros(30)]),
    "one": [3.0], "steep": np.geomspace(1e12, 1, 45), "flat": 1 + 1e-3 * np.random.default_rng(3).random(64),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_inertia_counts(name):
    v = matrix(SPECTRA[name])
    e = np.linalg.eigvalsh(v)
    for shift in [*(e[:-1] + e[1:]) / 2, e[0] - 1, e[-1] + 1, 0.37]:
        if np.abs(e - shift).min() > 1e-12 * abs(e[-1]):
            assert whitening.below(v, shift) == (e < shift).sum()
    assert whitening.below(np.zeros((3, 3)), 0.0) == 0
    assert whitening.below(np.array([[0, 1.0], [1, 0]]), 0.0) == 1


@pytest.mark.parametrize("name", SPECTRA)
def test_eigenpairs_by_contours(spark, name):
    v = matrix(SPECTRA[name])
    e, u = whitening.eigenpairs(spark, v, 32)
    want = np.linalg.eigvalsh(v)[::-1]
    want = want[:min(32, int((want > 8 * len(v) * np.finfo(float).eps * want[0]).sum()))]
    assert len(e) == len(want) and np.allclose(e, want, rtol=1e-12, atol=1e-14 * want[0])
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-12
    assert np.linalg.norm(v @ u - u * e, axis=0).max() < 1e-13 * len(v) * want[0]


def frame(spark, rows, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    for clash in ("vec", "n", "i", "part", "dim", "component", "my col"):
        df = df.withColumn(clash, F.lit("clash"))
    return df


def by_force(rows, scale=64, shift=1_000_000):
    """x, n, S and exact deviations of the rows that count."""
    fit = [(i, [math.floor(scale * float(np.float32(c))) + shift for c in v]) for i, v in rows
           if v and all(c is not None and math.isfinite(c) for c in v)]
    n, dim = len(fit), len(fit[0][1])
    s = [sum(x[j] for _, x in fit) for j in range(dim)]
    return fit, n, s, [sum((n * x[j] - s[j]) ** 2 for j in range(dim)) for _, x in fit]


def test_whitened_rows(spark):
    rng = np.random.default_rng(11)
    mix = rng.normal(size=(40, 40)) * np.geomspace(3, 1e-2, 40)
    rows = [(i, [float(np.float32(c)) for c in mix @ rng.normal(size=40) + 100]) for i in range(700)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, rows[9][1])]
    odd = [(900, None), (901, []), (902, [None] + [1.0] * 39), (903, [float("nan")] * 40), (904, [float("inf")] * 40)]
    out = whitening.whitened(frame(spark, rows + odd).repartition(7)).collect()
    fit, n, s, deviations = by_force(rows)
    assert len(out) == n * 32 and {r.n for r in out} == {n} and len({r.identity_error for r in out}) == 1
    x = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(v, s)] for _, v in fit])
    e, u = np.linalg.eigh(x.T @ x / n)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    want = x @ u / np.sqrt(e)
    got = {}
    for r in out:
        got.setdefault((r.vec_id, r.component), set()).add((r.deviation, r.whitened))
        assert abs(r.explained / (e[r.component - 1] / np.trace(x.T @ x / n)) - 1) < 1e-10
    sign = [np.sign(next(iter(got[0, k + 1]))[1] * want[0, k]) for k in range(32)]
    for i, (vec_id, _) in enumerate(fit):
        for k in range(32):
            assert any(d == deviations[i] and abs(w - sign[k] * want[i, k]) < 1e-7 for d, w in got[vec_id, k + 1])
    white = x @ u / np.sqrt(e)
    assert out[0].identity_error < 1e-9 and np.abs(white.T @ white / n - np.eye(32)).max() < 1e-9


def test_whitening_odd_inputs(spark):
    assert whitening.whitened(frame(spark, [])).collect() == []
    assert whitening.whitened(frame(spark, [(1, None), (2, [None])])).collect() == []
    out = whitening.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()  # no variance
    assert [(r.component, r.whitened, r.deviation) for r in out] == [(None, None, 0)] * 2
    out = whitening.whitened(frame(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [7.0])])).collect()  # two lengths, rank 1
    assert sorted((r.vec_id, r.component, r.deviation) for r in out[:2]) == [(1, 1, 2 * 64 ** 2), (2, 1, 2 * 64 ** 2)]
    assert {r.vec_id: r.component for r in out}[3] is None and all(abs(abs(r.whitened) - 1) < 1e-12 for r in out if r.component)
    big = whitening.whitened(frame(spark, [(1, [1e16]), (2, [-1e16]), (3, [1e300]), (4, [0.0])], "double")).collect()
    assert {r.vec_id: r.deviation for r in big}[1] is None and {r.vec_id for r in big} == {1, 2, 4}
    huge = whitening.whitened(frame(spark, [(1, [1e7]), (2, [-1e7])], "double")).collect()
    assert {r.deviation for r in huge} == {(2 * 640000000) ** 2}
