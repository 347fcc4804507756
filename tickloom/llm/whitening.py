"""Whitening by the leading eigenvectors of a covariance that is never formed.

Jacobi-Davidson with a block of vectors: the covariance V is known only through products
V B, one distributed pass over the rows each, which centre every row before multiplying.
A search space gives Ritz pairs (Rayleigh-Ritz); for each wanted pair (u, t) whose residual
is too large, a correction orthogonal to all wanted vectors is sought from

    (I - U U') (V - t I) (I - U U') z = -r

by a few steps of MINRES, all pairs in step, so one pass serves them all.  The corrections
extend the search space.  Pairs with a residual at rounding level are locked, the largest
first, and the search goes on orthogonal to them until all are.

Rows are whole numbers x, so their count, sums and squares are exact.  Partial products are
added as decimals: the order of tasks changes no digit.  What passes through the driver is
the block of vectors, dimension times its width.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import stage, table

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Steps of the inner solver, and vectors in the search space before it is cut back, per wanted vector.
INNER, SPACE = 4, 4
ROUNDS = 200
EPS = float(np.finfo(float).eps)


@dataclass(frozen=True)
class Moments:
    """Exact count and sums of the rows; ``centre`` and ``rest`` give the mean as centre + rest / n."""

    n: int
    sums: tuple[int, ...]
    trace: float

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def centre(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Written rows (vec_id, x): x = floor(1024 c) + 100000 of every entry, held within 62 bits.

    Rows without a vector, or with a null, NaN or infinite entry, are left out, and so are
    rows of another length than the commonest one (of several, the longest).
    """
    value = F.col(vector)
    bad = F.exists(value, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    limit = F.lit(float(1 << 62))

    def whole(c: Column) -> Column:
        return F.floor(F.greatest(F.least(c.cast("double") * SCALE, limit), -limit)).cast("long") + SHIFT

    kept = stage(rows.where(value.isNotNull() & ~bad).select("vec_id", F.transform(value, whole).alias("x")))
    sizes = kept.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).take(2)
    return kept if len(sizes) < 2 else kept.where(F.size("x") == sizes[0]["size"])


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as a matrix, a row each."""
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centred(x: np.ndarray, m: Moments) -> np.ndarray:
    """x minus the mean: the whole part exactly, then the fraction."""
    return (x - m.centre) - m.rest / m.n


def moments(rows: DataFrame) -> Moments | None:
    """Count, sums and trace of the covariance, without rounding; None without rows."""
    def added(square: bool, centre: np.ndarray | int) -> DataFrame:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = None, 0
            for batch in batches:
                if len(batch):
                    x = matrix(batch) - centre
                    # Products of whole numbers beyond 31 bits need Python's own.
                    fits = not square or np.abs(x).max(initial=0) < 1 << 26
                    x = x if fits and np.abs(x).max(initial=0) < 1 << 46 else x.astype(object)
                    part = [int(v) for v in ((x * x) if square else x).sum(axis=0)]
                    total = part if total is None else [a + b for a, b in zip(total, part)]
                    n += len(batch)
            if total is not None:
                total.append(n)
                yield pa.record_batch([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.decimal128(38, 0))], ["cell", "v"])

        return rows.select("x").mapInArrow(partial, "cell int, v decimal(38,0)").groupBy("cell").agg(F.sum("v").alias("v"))

    sums = [int(r.v) for r in added(False, 0).orderBy("cell").collect()]
    if not sums:
        return None
    n = sums.pop()
    about = Moments(n, tuple(sums), 0.0)
    squares = [int(r.v) for r in added(True, about.centre).orderBy("cell").collect()][:-1]
    trace = sum((Fraction(q, n) - Fraction(int(r), n) ** 2 for q, r in zip(squares, about.rest)), Fraction(0))
    return Moments(n, tuple(sums), float(trace))


def product(rows: DataFrame, m: Moments) -> Callable[[np.ndarray], np.ndarray]:
    """B -> V B / trace(V), one pass over the rows: each is centred, then multiplied."""
    def times(block: np.ndarray) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(block.shape)
            for batch in batches:
                c = centred(matrix(batch), m) if len(batch) else np.zeros((0, m.dim))
                total += c.T @ (c @ block)
            if total.size:
                yield pa.record_batch([pa.array(range(total.size), pa.int32()), pa.array((total / m.n / m.trace).ravel())], ["cell", "v"])

        parts = rows.select("x").mapInArrow(partial, "cell int, v double")
        cells = parts.groupBy("cell").agg(F.sum(F.col("v").cast("decimal(38,30)").cast("decimal(38,28)")).alias("v")).collect()
        out = np.zeros(block.size)
        for r in cells:
            out[r.cell] = r.v
        return out.reshape(block.shape)

    return times


# --- the eigenvectors -------------------------------------------------------------------

def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """The block made orthogonal to ``against`` and itself; columns that vanish are left out."""
    scale = np.linalg.norm(block, axis=0)
    block = block[:, scale > 0] / scale[scale > 0]
    kept = np.zeros((len(against), 0))
    for column in block.T:
        base = np.hstack([against, kept])
        for _ in range(3):
            column = column - base @ (base.T @ column)
            size = np.linalg.norm(column)
            if size < 1e-10:
                break
            column = column / size
        else:
            kept = np.hstack([kept, column[:, None]])
    return kept


def corrections(times: Callable[[np.ndarray], np.ndarray], wanted: np.ndarray, values: np.ndarray, residuals: np.ndarray, steps: int) -> np.ndarray:
    """A few MINRES steps for each projected correction equation, all in step: one product a step.

    Column k solves P (V - values[k]) P z = -residuals[k] with P = I - wanted wanted'.
    """
    def project(x: np.ndarray) -> np.ndarray:
        return x - wanted @ (wanted.T @ x)

    def safe(x: np.ndarray) -> np.ndarray:
        return np.where(np.abs(x) > 0, x, 1.0)

    right = project(-residuals)
    beta = np.linalg.norm(right, axis=0)
    old, v = np.zeros_like(right), right / safe(beta)
    d_old, d = np.zeros_like(right), np.zeros_like(right)
    z, eta = np.zeros_like(right), beta.copy()
    c_old, c, s_old, s = (np.full(len(beta), x) for x in (1.0, 1.0, 0.0, 0.0))
    live, beta_now = beta > 0, np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        w = project(times(v) - v * values) - old * beta_now
        alpha = (v * w).sum(axis=0)
        w = project(w - v * alpha)
        beta_next = np.linalg.norm(w, axis=0)
        # The new column of the tridiagonal matrix under the two last rotations and a new one.
        r3, r2 = s_old * beta_now, c_old * c * beta_now + s * alpha
        r1 = c * alpha - c_old * s * beta_now
        size = np.hypot(r1, beta_next)
        c_old, s_old = c, s
        c, s = r1 / safe(size), beta_next / safe(size)
        live = live & (size > 0)
        d_old, d = d, (v - d_old * r3 - d * r2) / safe(size)
        z = z + np.where(live, c * eta, 0.0) * d
        eta = -s * eta
        live = live & (beta_next > 1e-14)
        old, v, beta_now = v, np.where(live, w / safe(beta_next), 0.0), beta_next
    return z


def leading(times: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, residual norms) of the largest ``wanted`` eigenpairs, falling, of a matrix with trace one.

    A pair is locked when its residual is at the rounding level of the products, about
    ``dim`` units of the last place of the largest value.
    """
    start = np.random.default_rng(20).standard_normal((dim, min(dim, 2 * wanted)))
    locked, values, norms = np.zeros((dim, 0)), [], []
    q = orthonormal(start, locked)
    w = times(q)
    for _ in range(ROUNDS):
        h = q.T @ w
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        q, w = q @ y, w @ y
        rest = wanted - locked.shape[1]
        residuals = w[:, :rest] - q[:, :rest] * theta[:rest]
        residuals -= locked @ (locked.T @ residuals)
        sizes = np.linalg.norm(residuals, axis=0)
        floor = dim * EPS * max([theta[0], *values])
        # The search space is the whole complement: its Ritz pairs are exact up to rounding.
        done = rest if q.shape[1] + locked.shape[1] >= dim else int(np.argmin(np.append(sizes <= floor, False)))
        locked = np.hstack([locked, q[:, :done]])
        values += list(theta[:done])
        norms += list(sizes[:done])
        if len(values) == wanted:
            break
        open_ = slice(done, rest)
        near = np.hstack([locked, q[:, open_]])
        z = corrections(times, near, theta[open_], residuals[:, open_], INNER)
        q, w = q[:, done:], w[:, done:]
        if q.shape[1] > SPACE * wanted:
            q, w = q[:, :2 * wanted], w[:, :2 * wanted]
        new = orthonormal(z, np.hstack([locked, q]))
        if not new.shape[1]:
            new = orthonormal(np.random.default_rng(len(norms) + q.shape[1]).standard_normal((dim, min(wanted, dim - q.shape[1] - locked.shape[1]))), np.hstack([locked, q]))
        q, w = np.hstack([q, new]), np.hstack([w, times(new)])
    else:
        raise RuntimeError(f"no convergence in {ROUNDS} rounds")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order], np.array(norms)[order]


# --- whitening --------------------------------------------------------------------------

def whitening(rows: DataFrame, components: int = COMPONENTS) -> tuple[Moments, np.ndarray, np.ndarray] | None:
    """Moments, eigenvalues and vectors of the rows (x); directions without variance are left out, None if there is none."""
    m = moments(rows)
    if m is None or not m.trace > 0:
        return None
    values, vectors, _ = leading(product(rows, m), m.dim, min(components, m.dim))
    real = values > m.dim * EPS * values[0]
    return m, values[real] * m.trace, vectors[:, real]


def deviations(x: np.ndarray, m: Moments) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
    centre, rest = m.centre, m.rest
    about = ((m.n * centred(x, m)) ** 2).sum(axis=1)
    # 64-bit arithmetic wraps, so it is exact wherever the result fits.
    with np.errstate(over="ignore"):
        wrapped = ((np.int64(m.n) * (x - centre) - rest) ** 2).sum(axis=1)
    out = []
    for row, size, value in zip(x, about, wrapped.tolist()):
        if size > 9e18:
            value = sum((m.n * (int(a) - int(b)) - int(r)) ** 2 for a, b, r in zip(row, centre, rest))
        out.append(value if value < 1 << 63 else None)
    return out


def whitened(rows: DataFrame, m: Moments, values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(vec_id, deviation, whitened) of every row: one number per component."""
    scaled = vectors / np.sqrt(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = matrix(batch)
                yield pa.record_batch([batch.column("vec_id"), pa.array(deviations(x, m), pa.int64()), pa.array(list(centred(x, m) @ scaled), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(project, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, components: int, n: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity; the mean comes first, then centred products."""
    def added(mean: np.ndarray | None) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(components if mean is None else (components, components))
            for batch in batches:
                w = batch.column("whitened").flatten().to_numpy().reshape(-1, components)
                total += w.sum(axis=0) if mean is None else (w - mean).T @ (w - mean)
            yield pa.record_batch([pa.array(range(total.size), pa.int32()), pa.array((total / n).ravel())], ["cell", "v"])

        found = rows.select("whitened").mapInArrow(partial, "cell int, v double").groupBy("cell").agg(F.sum(F.col("v").cast("decimal(38,28)")).alias("v")).orderBy("cell").collect()
        return np.array([float(r.v) for r in found])

    return float(np.abs(added(added(None)).reshape(components, components) - np.eye(components)).max())


def op11_jacobi_davidson(spark: SparkSession, folder: str) -> DataFrame:
    """Every remaining row's whitened entries, up to eight components.

    Rows whose vector is null or holds a null, NaN or infinite entry are left out, as are
    vectors of another length than the commonest one.  Repeated rows count as often as they
    stand; a null vec_id is kept.  Directions without variance are no components, so equal
    vectors alone, one vector or an empty table give no rows.
    """
    rows = whole_vectors(table(spark, folder, "embeddings").select("vec_id", "embedding"))
    found = whitening(rows)
    if found is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    m, values, vectors = found
    done = stage(whitened(rows, m, values, vectors))
    error = identity_error(done, len(values), m.n)
    explained = F.array(*[F.lit(float(v / m.trace)) for v in values])
    out = done.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(m.n).cast("long").alias("n"), "deviation", "whitened",
                      F.element_at(explained, F.col("k") + 1).alias("explained"), F.lit(error).alias("identity_error"))
