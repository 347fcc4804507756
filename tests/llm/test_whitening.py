"""Whitening against numpy's dense solver and exact whole numbers."""

import math

import numpy as np
import pytest

from tickloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, x string, cell int, whitened string, n int"


def write(spark, folder, rows):
    spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x", 1, "y", 2) for i, v in rows], SCHEMA).write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def fits(rows, dim):
    out = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v):
            out.append((i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]))
    return out


def compare(spark, folder, rows, dim):
    got = W.op11_jacobi_davidson(spark, write(spark, folder, rows)).collect()
    kept = fits(rows, dim)
    x = np.array([v for _, v in kept], float)
    n, sums = len(kept), [sum(v[k] for _, v in kept) for k in range(dim)]
    c = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = sum(v > 1e-10 * values[0] for v in values[:8])
    assert len(got) == n * count
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
        assert r.n == n and r.identity_error < 1e-7 and abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-7
    exact = sorted(((i is None, i or 0), sum((n * v[k] - sums[k]) ** 2 for k in range(dim))) for i, v in kept)
    for k, mine in by.items():
        assert sorted(((r.vec_id is None, r.vec_id or 0), r.deviation) for r in mine) == exact
    return got, values, vectors, kept, c


def test_components(spark, tmp_path):
    r = np.random.default_rng(1)
    base = r.standard_normal((700, 24)) * np.linspace(2.0, 0.3, 24) @ np.linalg.qr(r.standard_normal((24, 24)))[0] + r.standard_normal(24)
    rows = [(int(i), list(v)) for i, v in enumerate(base)]
    rows += [(5000, None), (5001, [None] + [0.5] * 23), (5002, [float("nan")] * 24), (5003, [float("inf")] + [0.0] * 23), (5004, [1.0] * 3), (5005, []), (None, [0.25] * 24)] + [(6000, [0.5] * 24)] * 40
    got, values, vectors, kept, c = compare(spark, tmp_path, rows, 24)
    want = c @ vectors[:, :8] / np.sqrt(values[:8])
    index = {i: k for k, (i, _) in enumerate(kept)}
    have = np.zeros_like(want)
    for x in got:
        have[index[x.vec_id], x.component - 1] = x.whitened
    rows_seen = sorted(set(index.values()))
    for k in range(8):
        a, b = have[rows_seen, k], want[rows_seen, k]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9


def test_hot_vector_and_low_rank(spark, tmp_path):
    r = np.random.default_rng(2)
    plane = r.standard_normal((60, 3)) @ np.array([[1, 0, 1, 0, 2, 0], [0, 1, 0, 1, 0, 2], [1, 1, 0, 0, 0, 0]]) / 4
    rows = [(i, [round(c * 1024) / 1024 for c in v]) for i, v in enumerate(plane)] + [(900, [0.5] * 6)] * 200
    compare(spark, tmp_path / "a", rows, 6)
    line = [(i, [i / 4, -i / 8, 0.0]) for i in range(20)]
    got = W.op11_jacobi_davidson(spark, write(spark, tmp_path / "b", line)).collect()
    assert len(got) == 20 and {x.component for x in got} == {1} and abs(got[0].explained - 1) < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]])
def test_nothing_to_whiten(spark, tmp_path, rows):
    out = W.op11_jacobi_davidson(spark, write(spark, tmp_path, rows))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0


@pytest.mark.parametrize("spectrum", ["close", "equal", "steep", "flat"])
def test_solver(spectrum):
    """Locked pairs reach the rounding level, whatever the gaps."""
    d, r = 64, np.random.default_rng(4)
    e = {"close": 1 + np.arange(d) * 1e-3, "equal": np.repeat([1.0, 2.0, 3.0, 4.0], 16), "steep": 10.0 ** -np.arange(d, dtype=float).clip(0, 13), "flat": 1 + r.random(d) * 1e-6}[spectrum]
    q = np.linalg.qr(r.standard_normal((d, d)))[0]
    v = (q * (e / e.sum())) @ q.T
    passes = []
    values, vectors, _ = W.leading(lambda b: passes.append(1) or v @ b, d, 8)
    assert np.abs(values - np.sort(e / e.sum())[::-1][:8]).max() < 1e-13
    assert np.linalg.norm(v @ vectors - vectors * values, axis=0).max() < 4 * d * W.EPS * values[0]
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12 and len(passes) < 80


def test_inner_solver_is_minres():
    """As many steps as dimensions solve the projected equation."""
    r = np.random.default_rng(5)
    a = r.standard_normal((12, 12))
    a = a + a.T
    u = np.linalg.qr(r.standard_normal((12, 2)))[0]
    p = np.eye(12) - u @ u.T
    right = p @ r.standard_normal((12, 2))
    z = W.corrections(lambda b: a @ b, u, np.array([0.3, -0.2]), right, 14)
    for k, t in enumerate((0.3, -0.2)):
        assert np.linalg.norm(p @ (a - t * np.eye(12)) @ p @ z[:, k] + right[:, k]) < 1e-8
        short = W.corrections(lambda b: a @ b, u, np.array([0.3, -0.2]), right, 4)[:, k]
        op = p @ (a - t * np.eye(12)) @ p
        krylov = np.stack([np.linalg.matrix_power(op, j) @ right[:, k] for j in range(4)], axis=1)
        least = np.linalg.lstsq(op @ krylov, -right[:, k], rcond=None)[0]
        assert abs(np.linalg.norm(op @ short + right[:, k]) - np.linalg.norm(op @ krylov @ least + right[:, k])) < 1e-8


def test_deviation_beyond_a_long():
    x = np.array([[10**9, 0], [-10**9, 0], [1, 1]])
    m = W.Moments(10**6, (0, 0), 1.0)
    assert W.deviations(x, m) == [None, None, 2 * 10**12]
