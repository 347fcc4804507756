"""Nearest neighbours in the maximum norm, and the information measures built on them.

Points of many spaces, one per task, are cut into cells that hold at most ``size`` different
points: every round cuts each larger cell along its widest side at approximate quantiles.
A query walks down the tree of boxes by joins, only into boxes that its own box touches, and
meets the points of a cell in a stream.  No space, however large, has to fit one task.

* The k-th distance starts inside the point's own cell, which bounds it; only the cells
  that this bound reaches are looked at then, so the result is exact.
* Counts within a distance take boxes that lie inside whole and look into the others.

A space has up to four coordinates; those that it lacks are zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.ordered import hash_text
from tickloom.sources.sinks import stage

COORDS = ["c0", "c1", "c2", "c3"]
CELL, FAN, CHUNK = 1024, 16, 256
#: Neighbours per measure and the level of noise that parts equal values, as usual for these estimators.
NEIGHBOURS = {"mi": 5, "cmi": 4, "te": 5, "cte": 4}
NOISE = 1e-8
#: Coordinates of a measure's joint space and of the spaces it counts in, with the sign of their term.
SPACES = {
    "mi": ("xy", {"x": -1, "y": -1}),
    "cmi": ("xyz", {"xz": -1, "yz": -1, "z": 1}),
    "te": ("xyp", {"xp": -1, "yp": -1, "p": 1}),
    "cte": ("xypz", {"xpz": -1, "ypz": -1, "pz": 1}),
}
EULER = 0.5772156649015328606


# --- cells ------------------------------------------------------------------------------

@dataclass(frozen=True)
class Cells:
    """Written tables: ``leaves`` (cell, at, m, points) as arrays per leaf, ``levels`` of boxes (parent, cell, n, w, lo, hi) from the roots down."""

    leaves: DataFrame
    levels: list[DataFrame]
    size: int


def different(points: DataFrame) -> DataFrame:
    """(space, at, c0..c3, w): equal points of a space once, with their number; ``at`` numbers the rows."""
    some = points.groupBy("space", *COORDS).agg(F.count("*").alias("w"))
    return stage(some.withColumn("at", F.monotonically_increasing_id()))


def cells(points: DataFrame, size: int = CELL) -> Cells:
    """Cut the written ``points`` of every space; one round of aggregates per level, about log16(points / size) levels."""
    live = points.select(F.concat(F.lit("^"), F.col("space")).alias("parent"), F.col("space").alias("cell"), "at", "w", *COORDS)
    levels, done = [], []
    lo, hi = F.array(*[F.min(c) for c in COORDS]), F.array(*[F.max(c) for c in COORDS])
    while True:
        boxes = stage(live.groupBy("parent", "cell").agg(F.count("*").alias("n"), F.sum("w").alias("w"), lo.alias("lo"), hi.alias("hi")))
        levels.append(boxes)
        wide = F.zip_with("hi", "lo", lambda a, b: a - b)
        big = boxes.where(F.col("n") > size).select("cell", F.array_position(wide, F.array_max(wide)).cast("int").alias("axis"))
        if big.isEmpty():
            done.append(live)
            break
        done.append(live.join(big, "cell", "left_anti").select(*live.columns))
        chosen = live.join(big, "cell").withColumn("v", F.element_at(F.array(*COORDS), F.col("axis")))
        cut = chosen.groupBy("cell").agg(F.percentile_approx("v", [i / FAN for i in range(1, FAN)], 1000).alias("q"), F.min("v").alias("low"), F.max("v").alias("high"))
        some = F.array_distinct(F.filter("q", lambda e: e < F.col("high")))
        middle = (F.col("low") + F.col("high")) / 2
        middle = F.array(F.when(middle < F.col("high"), middle).otherwise(F.col("low")))
        cut = cut.select("cell", F.when(F.size(some) > 0, some).otherwise(middle).alias("q"))
        child = F.size(F.filter("q", lambda e: e < F.col("v")))
        live = stage(chosen.join(cut, "cell").select(F.col("cell").alias("parent"), F.concat("cell", F.lit("."), child).alias("cell"), "at", "w", *COORDS))
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    rows = F.collect_list(F.struct("at", "w", *COORDS))
    leaves = found.groupBy("cell").agg(rows.alias("x")).select("cell", F.col("x.at").alias("at"), F.col("x.w").alias("m"), F.flatten(F.transform("x", lambda p: F.array(*[p[c] for c in COORDS]))).alias("points"))
    return Cells(stage(leaves), levels, size)


def gap(lo: Column, hi: Column, c: Column) -> Column:
    """Distance of a point to a box."""
    sides = F.zip_with(F.zip_with(lo, c, lambda a, x: a - x), F.zip_with(c, hi, lambda x, b: x - b), lambda a, b: F.greatest(a, b))
    return F.greatest(F.array_max(sides), F.lit(0.0))


def reach(lo: Column, hi: Column, c: Column) -> Column:
    """Distance of a point to the farthest point of a box."""
    return F.array_max(F.zip_with(F.zip_with(c, lo, lambda x, a: x - a), F.zip_with(hi, c, lambda b, x: b - x), lambda a, b: F.greatest(a, b)))


def visits(queries: DataFrame, tree: Cells, whole: bool) -> tuple[DataFrame, DataFrame | None]:
    """(cell, at, c, r) of the leaves that the queries (space, at, c, r) touch; with ``whole`` boxes inside r come apart, as (at, w)."""
    front = queries.select("at", "c", "r", F.concat(F.lit("^"), F.col("space")).alias("node"))
    found, inside = None, None
    for level in tree.levels:
        hit = front.join(level, F.col("node") == F.col("parent")).where(gap(F.col("lo"), F.col("hi"), F.col("c")) < F.col("r"))
        if whole:
            hit = hit.withColumn("all", reach(F.col("lo"), F.col("hi"), F.col("c")) < F.col("r"))
            part = hit.where("all").select("at", F.col("w").alias("found"))
            inside = part if inside is None else inside.unionByName(part)
            hit = hit.where("not all")
        leaf = hit.where(F.col("n") <= tree.size).select("cell", "at", "c", "r")
        found = leaf if found is None else found.unionByName(leaf)
        front = hit.where(F.col("n") > tree.size).select("at", "c", "r", F.col("cell").alias("node"))
    return found, inside


def distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Largest coordinate difference of every query to every point."""
    out = np.abs(q[:, None, 0] - p[None, :, 0])
    for k in range(1, q.shape[1]):
        if q[:, k].any() or p[:, k].any():
            np.maximum(out, np.abs(q[:, None, k] - p[None, :, k]), out=out)
    return out


def streamed(leaves: DataFrame, met: DataFrame, answer, result: str) -> DataFrame:
    """(at, found) of visits: every leaf's points come first, its queries follow in batches; ``answer(queries, radii, points, copies)``."""
    none = F.lit(None)
    left = leaves.select("cell", F.lit(0).alias("kind"), none.cast("long").alias("at"), none.cast("double").alias("r"), "points", "m")
    right = met.select("cell", F.lit(1).alias("kind"), "at", "r", F.col("c").alias("points"), none.cast("array<long>").alias("m"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell = points = copies = None
        for batch in batches:
            names, kinds = batch["cell"].to_numpy(), batch["kind"].to_numpy()
            ats, rs, arrays, ms = batch["at"].to_numpy(), batch["r"].to_numpy(), batch["points"].to_numpy(), batch["m"].to_numpy()
            at, end = 0, len(batch)
            while at < end:
                if kinds[at] == 0:
                    cell, points, copies = names[at], np.asarray(arrays[at], float).reshape(-1, len(COORDS)), np.asarray(ms[at], np.int64)
                    at += 1
                    continue
                to = at
                while to < end and to - at < CHUNK and kinds[to] == 1 and names[to] == names[at]:
                    to += 1
                if names[at] != cell:
                    raise RuntimeError(f"a query came before the points of cell {names[at]}")
                yield pd.DataFrame({"at": ats[at:to].astype(np.int64), "found": list(answer(np.stack(list(arrays[at:to])), rs[at:to].astype(float), points, copies))})
                at = to

    both = left.unionByName(right).repartition("cell").sortWithinPartitions("cell", "kind")
    return both.mapInPandas(run, f"at long, found {result}")


# --- searches ---------------------------------------------------------------------------

def nearest(q: np.ndarray, points: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distances of every query, copies counted, ascending; fewer where there are fewer points."""
    d = distances(q, points)
    if (copies > 1).any():
        d = np.repeat(d, np.minimum(copies, k), axis=1)
    if d.shape[1] > k:
        d = np.partition(d, k - 1, axis=1)[:, :k]
    return np.sort(d, axis=1)


def neighbour_distances(points: DataFrame, k: int, size: int = CELL) -> DataFrame:
    """(space, at, c0..c3, w, near): ``near`` holds the distances to the k nearest other points, ascending; copies of a point are others."""
    tree = cells(points, size)

    def inside(leaves: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for flat, copies in leaves:
            out = []
            for f, m in zip(flat, copies):
                p, m = np.asarray(f, float).reshape(-1, len(COORDS)), np.asarray(m, np.int64)
                # The first of k + 1 is the point itself.
                out.append([list(row[1:]) for at in range(0, len(p), CHUNK) for row in nearest(p[at:at + CHUNK], p, m, k + 1)])
            yield pd.Series(out)

    own = tree.leaves.withColumn("near", F.pandas_udf(inside, "array<array<double>>")("points", "m"))
    own = own.select("cell", F.explode(F.arrays_zip("at", "near")).alias("x")).select(F.col("cell").alias("home"), "x.at", "x.near")
    own = stage(own)
    start = points.join(own, "at").withColumn("r", F.when(F.size("near") >= k, F.element_at("near", -1)).otherwise(F.lit(float("inf"))))
    met, _ = visits(start.select("space", "at", F.array(*COORDS).alias("c"), "r"), tree, False)
    met = met.join(own.select(F.col("at").alias("a"), "home"), (F.col("at") == F.col("a")) & (F.col("cell") == F.col("home")), "left_anti")
    more = streamed(tree.leaves, met, lambda q, r, p, m: map(list, nearest(q, p, m, k)), "array<double>")
    every = own.select("at", F.col("near").alias("found")).unionByName(more)
    merged = every.groupBy("at").agg(F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k).alias("near"))
    return points.join(merged, "at")


def counts_within(points: DataFrame, queries: DataFrame, size: int = CELL) -> DataFrame:
    """(at, n): points of the query's space nearer than r, for ``queries`` (space, at, c0..c3, r); a point at the query counts if r is above 0."""
    tree = cells(points, size)
    asked = queries.select("space", "at", F.array(*COORDS).alias("c"), "r")
    met, inside = visits(asked, tree, True)

    def count(q: np.ndarray, r: np.ndarray, p: np.ndarray, m: np.ndarray) -> np.ndarray:
        return (distances(q, p) < r[:, None]) @ m

    found = streamed(tree.leaves, met, count, "long").unionByName(inside)
    return found.groupBy("at").agg(F.sum("found").alias("n"))


# --- information measures ---------------------------------------------------------------

def digamma(n: Column) -> Column:
    """Digamma of whole numbers from 1, to about 1e-12: harmonic numbers, then the asymptotic series."""
    small = F.array(*[F.lit(math.fsum(1.0 / i for i in range(1, m)) - EULER) for m in range(1, 17)])
    x = n.cast("double")
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x ** 2) + 1 / (120 * x ** 4) - 1 / (252 * x ** 6)
    return F.when(n <= 16, F.element_at(small, F.least(n, F.lit(16)).cast("int"))).otherwise(series)


def jitter(name: str, key: str, level: float) -> Column:
    """Seeded noise in [-level / 2, level / 2) from a row's key."""
    share = F.conv(F.substring(hash_text(f"_{name}_{key}", 42), 1, 12), 16, 10).cast("double") / float(16 ** 12)
    return (share - 0.5) * level


def neighbour_information(long: DataFrame, keys: list[str], row: str, measures: tuple[str, ...] = tuple(SPACES), noise: float = NOISE, size: int = CELL, least: int = 10) -> DataFrame:
    """Nearest-neighbour estimates in nats per task, a column per measure.

    ``long`` has the task's ``keys``, x, the later y, the target now z, the target before p and
    ``row``, a number of the row.  mi = I(x;y), cmi = I(x;y|z), te = I(x;y|p), cte = I(x;y|p,z).
    mi and cmi use rows with x, y and z, the others rows that also have p; ``n_samples`` counts
    the former.  The k-th neighbour (``NEIGHBOURS``) is searched in the joint space of a
    measure, points nearer than it are counted in the parts.  Tasks with fewer than ``least``
    rows are left out.
    """
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    base = long.where(ok)
    if noise:
        base = base.withColumns({f"_{v}_{row}": F.concat(F.lit(f"{v}:"), F.col(row).cast("string")) for v in "xyzp"})
        base = base.withColumns({v: F.col(v) + jitter(v, row, noise) for v in "xyzp"})
    enough = long.groupBy(*keys).agg(F.count_if(ok).alias("n_samples"), F.count_if(ok & F.col("p").isNotNull()).alias("with_past")).where(F.col("n_samples") >= least)
    base = base.join(stage(enough).select(*keys), keys, "left_semi").withColumn("task", F.concat_ws("|", *[F.col(c).cast("string") for c in keys]))
    base = stage(base.select("task", *"xyzp"))

    def coords(names: str) -> list[Column]:
        return [(F.col(names[i]) if i < len(names) else F.lit(0.0)).alias(c) for i, c in enumerate(COORDS)]

    joint = None
    for m in measures:
        names = SPACES[m][0]
        part = base.where("p is not null") if "p" in names else base
        part = part.select(F.concat(F.col("task"), F.lit(f"|{m}")).alias("space"), *coords(names))
        joint = part if joint is None else joint.unionByName(part)
    k = {m: NEIGHBOURS[m] for m in measures}
    points = different(joint)
    found = neighbour_distances(points, max(k.values()), size)
    which = F.element_at(F.split("space", "\\|"), -1)
    kth = F.lit(None).cast("int")
    for m in measures:
        kth = F.when(which == m, F.lit(k[m])).otherwise(kth)
    found = found.withColumns({"measure": which, "k": kth}).where(F.size("near") >= F.col("k"))
    found = stage(found.select("at", "space", "measure", "k", "w", *COORDS, F.element_at("near", F.col("k")).alias("r")))

    parts = F.lit(None).cast("array<struct<part: string, sign: int, xs: array<double>>>")
    zero = F.lit(0.0)
    for m in measures:
        names, some = SPACES[m]
        own = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(s).alias("sign"), F.array(*[F.col(COORDS[names.index(v)]) for v in p], *[zero] * (len(COORDS) - len(p))).alias("xs")) for p, s in some.items()])
        parts = F.when(F.col("measure") == m, own).otherwise(parts)
    asked = found.select("space", "at", "w", "r", F.explode(parts).alias("x"))
    asked = asked.select(F.concat("space", F.lit("|"), "x.part").alias("space"), F.col("at").alias("point"), "w", "r", "x.sign", *[F.col("x.xs")[i].alias(c) for i, c in enumerate(COORDS)])
    asked = stage(asked.withColumn("at", F.monotonically_increasing_id()))
    there = asked.groupBy("space", *COORDS).agg(F.sum("w").cast("long").alias("w")).withColumn("at", F.monotonically_increasing_id())
    counted = counts_within(stage(there), asked, size)
    terms = asked.join(counted, "at", "left").select("point", (F.col("sign") * digamma(F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)))).alias("term"))
    each = terms.groupBy("point").agg(F.sum("term").alias("term")).join(found, F.col("point") == F.col("at"))
    mean = each.groupBy("space", "measure", "k").agg((F.sum(F.col("term") * F.col("w")) / F.sum("w")).alias("mean"), F.sum("w").alias("n"))
    value = digamma(F.col("k")) + F.col("mean") + F.when(F.col("measure") == "mi", digamma(F.col("n"))).otherwise(0.0)
    split = F.split("space", "\\|")
    out = mean.groupBy(F.array_join(F.slice(split, 1, F.size(split) - 1), "|").alias("task")).agg(*[F.max(F.when(F.col("measure") == m, value)).alias(m) for m in measures])
    named = enough.withColumn("task", F.concat_ws("|", *[F.col(c).cast("string") for c in keys]))
    return named.join(out, "task").select(*keys, "n_samples", *measures)
