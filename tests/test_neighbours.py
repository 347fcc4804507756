"""Neighbour searches and information measures against all pairs and closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import neighbours as N


def psi(n):
    return math.fsum(1.0 / i for i in range(1, n)) - N.EULER


def plain(cols, measure, k):
    """All pairs: the estimator as it is written."""
    names, parts = N.SPACES[measure]
    def dist(vs):
        return np.max([np.abs(cols[v][:, None] - cols[v][None, :]) for v in vs], axis=0)
    joint = dist(names)
    np.fill_diagonal(joint, np.inf)
    r = np.sort(joint, axis=1)[:, k - 1]
    total = psi(k) + (psi(len(r)) if measure == "mi" else 0.0)
    for part, sign in parts.items():
        n = (dist(part) < r[:, None]).sum(axis=1)
        total += sign * np.mean([psi(max(int(m), 1)) for m in n])
    return total


def frame(spark, cols, task=1):
    n = len(cols["x"])
    return spark.createDataFrame([(task, i, *[float(cols[v][i]) for v in "xyzp"]) for i in range(n)], "task_id int, ep long, x double, y double, z double, p double")


def gaussian(seed, n, rho):
    r = np.random.default_rng(seed)
    x, e, z, p = r.standard_normal((4, n))
    return {"x": x, "y": rho * x + math.sqrt(1 - rho * rho) * e, "z": z, "p": p}


def test_all_pairs(spark):
    """2,000 rows of two tasks, small cells, equal values among them."""
    a, b = gaussian(1, 2000, 0.7), gaussian(2, 300, 0.0)
    b = {v: np.round(c, 1) for v, c in b.items()}
    long = frame(spark, a, 1).unionByName(frame(spark, b, 2)).unionByName(frame(spark, gaussian(3, 9, 0.5), 3))
    got = {r.task_id: r for r in N.neighbour_information(long, ["task_id"], "ep", noise=0.0, size=100).collect()}
    assert sorted(got) == [1, 2] and got[1].n_samples == 2000
    for task, cols in ((1, a), (2, b)):
        for m, k in N.NEIGHBOURS.items():
            assert abs(got[task][m] - plain(cols, m, k)) < 1e-9, (task, m)


@pytest.mark.parametrize("rho", [0.6, 0.9])
def test_closed_form(spark, rho):
    """Gaussian pairs: I = -ln(1 - rho^2) / 2, and what z explains is gone."""
    n = 6000
    cols = gaussian(7, n, rho)
    got = N.neighbour_information(frame(spark, cols), ["task_id"], "ep", ("mi",)).first()
    assert abs(got.mi / (-0.5 * math.log(1 - rho * rho)) - 1) < 0.05
    r = np.random.default_rng(8)
    z = r.standard_normal(n)
    common = {"x": z + 0.3 * r.standard_normal(n), "y": z + 0.3 * r.standard_normal(n), "z": z, "p": r.standard_normal(n)}
    got = N.neighbour_information(frame(spark, common), ["task_id"], "ep", ("mi", "cmi")).first()
    assert got.mi > 0.8 and abs(got.cmi) < 0.05


def test_cells_are_bounded(spark):
    """Heavy ties, a line, an outlier: no leaf above its size, every point in one leaf."""
    r = np.random.default_rng(4)
    points = [("a", 0.0, float(v), 0.0, 0.0) for v in r.random(700)] + [("a", 1e9, 0.5, 0.0, 0.0)] + [("a", 0.0, 0.25, 0.0, 0.0)] * 500
    points += [("b", float(i), float(i), 0.0, 0.0) for i in range(400)] + [("c", 1.0, 1.0, 1.0, 1.0)] * 900
    some = N.different(spark.createDataFrame(points, "space string, c0 double, c1 double, c2 double, c3 double"))
    tree = N.cells(some, 50)
    leaves = tree.leaves.collect()
    assert max(len(x["at"]) for x in leaves) <= 50 and len({a for x in leaves for a in x["at"]}) == some.count() == sum(len(x["at"]) for x in leaves)
    assert sum(sum(x["m"]) for x in leaves) == len(points)


def test_distances_and_counts(spark):
    r = np.random.default_rng(5)
    p = np.round(r.standard_normal((500, 3)), 1)
    rows = spark.createDataFrame([("s", *map(float, v), 0.0) for v in p], "space string, c0 double, c1 double, c2 double, c3 double")
    some = N.different(rows)
    near = N.neighbour_distances(some, 6, 40).collect()
    full = np.abs(p[:, None] - p[None]).max(axis=2)
    for x in near:
        i = int(np.flatnonzero((p == (x.c0, x.c1, x.c2)).all(axis=1))[0])
        d = np.sort(np.delete(full[i], i))[:6]
        assert np.allclose(x.near, d, atol=0)
    asked = some.select("space", "at", *N.COORDS, (F.lit(0.35) + F.col("c0") * 0).alias("r"))
    counts = {x.at: x.n for x in N.counts_within(some, asked, 40).collect()}
    for x in near:
        i = int(np.flatnonzero((p == (x.c0, x.c1, x.c2)).all(axis=1))[0])
        assert counts[x.at] == (full[i] < 0.35).sum()


def test_digamma(spark):
    got = spark.range(1, 60).select("id", N.digamma(F.col("id")).alias("v")).collect()
    assert all(abs(x.v - psi(x.id)) < 2e-12 for x in got)


def test_nothing(spark):
    empty = spark.createDataFrame([], "task_id int, ep long, x double, y double, z double, p double")
    assert N.neighbour_information(empty, ["task_id"], "ep").count() == 0
    nulls = spark.createDataFrame([(1, i, 1.0, None, 1.0, 1.0) for i in range(20)], empty.schema)
    assert N.neighbour_information(nulls, ["task_id"], "ep").count() == 0
