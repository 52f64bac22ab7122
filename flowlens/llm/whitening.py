"""Embedding whitening by principal components, found by contour integration (the FEAST method).

Entries become integers on a grid (``STEPS`` to a unit), so that sums are exact.  Spark adds up the number of vectors and their sums, then
the centred products of each task's vectors, a matrix of dimension x dimension per task; what reaches the driver is one such matrix,
whose size depends on the dimension only.  There, the eigenvalues that are wanted are fenced in: the inertia of a shifted
matrix (the signs of its block factors) counts the eigenvalues below the shift, and bisection on these counts gives intervals of at most
``INSIDE`` eigenvalues each.  On an interval, the resolvent integrated around it by Gauss-Legendre quadrature (solves with
complex shifts) projects random vectors onto the eigenspace; a Rayleigh-Ritz step in that space gives eigenpairs, and this is
repeated until the residuals are at rounding level.  An interval that has other than the counted number of pairs is an error.
Spark then projects all vectors, and adds up the products of the results (whose mean is 0) to measure how far these are from white.

Vectors that are null or empty, or hold null or non-finite entries, or entries beyond 2 ** 40 in size, take no part and give no rows.  Of vectors of several lengths, the
most frequent length (of equally frequent ones, the greatest) takes part.  Rows that repeat a vec_id, and a null vec_id, count and are returned each.
Components without variance (less than ``dimension * 1e-13`` of the largest eigenvalue) can't be whitened and are left out; there are none for
an empty table or equal vectors, and then no rows.  Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

STEPS, SHIFT = 64, 1_000_000
#: Components that are kept, eigenvalues in an interval, quadrature points of a half circle, rounds of projection.
MOST, INSIDE, POINTS, ROUNDS = 32, 8, 12, 30
#: Dimensions that the driver's matrix is bounded by.
MOST_DIMENSIONS = 8192


class Fit(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def usable(rows: DataFrame, vector: str) -> Column:
    """Whether a vector may take part, apart from its length."""
    v = F.col(vector)
    good = lambda x: x.isNotNull() & (F.abs(x.cast("double")) <= float(1 << 40))  # noqa: E731  # NaN is greater than any number
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, good)


def inertia(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``a`` are less than ``shift``: negative ones among the blocks of a symmetric
    elimination with full pivoting on blocks of one or two rows."""
    m, below = a - shift * np.eye(len(a)), 0
    while len(m):
        size = np.abs(m)
        diagonal = np.abs(np.diag(m))
        i = int(diagonal.argmax())
        p, q = np.unravel_index(int(size.argmax()), m.shape)
        if size[p, q] == 0:
            return below
        block = [i] if diagonal[i] >= 0.6404 * size[p, q] else [int(p), int(q)]
        pivot = m[np.ix_(block, block)]
        below += int(pivot[0, 0] < 0) if len(block) == 1 else 1  # a block of two has a negative determinant
        rest = np.setdiff1d(np.arange(len(m)), block)
        side = m[np.ix_(rest, block)]
        m = m[np.ix_(rest, rest)] - side @ np.linalg.solve(pivot, side.T)
        m = (m + m.T) / 2
    return below


def intervals(a: np.ndarray, most: int, inside: int = INSIDE) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues) from the top down, until ``most`` eigenvalues are in.

    An interval that holds more than ``inside`` is halved unless it is narrower than rounding can tell: equal eigenvalues stay together.
    """
    top = float(np.abs(a).sum(axis=1).max()) * 1.01 or 1.0
    counts: dict[float, int] = {}

    def below(x: float) -> int:
        if x not in counts:
            counts[x] = inertia(a, x)
        return counts[x]

    found, open_, have = [], [(-0.01 * top, top)], 0
    while open_ and have < most:
        low, high = open_.pop()
        n = below(high) - below(low)
        if not n:
            continue
        if n <= inside or high - low < 1e-12 * top:
            found.append((low, high, n))
            have += n
        else:  # cut off the middle: the eigenvalues of covariances crowd at the lower end
            middle = (low + high) / 2
            open_ += [(low, middle), (middle, high)]
    return found


def eigenpairs(a: np.ndarray, low: float, high: float, n: int, known: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` eigenvalues of ``a`` in [low, high) and their unit vectors, at right angles to the ``known`` ones of other intervals."""
    d = len(a)
    size = min(d - known.shape[1], 2 * n + 4)
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    turn = np.exp(1j * np.pi * (1 - nodes) / 2)  # the upper half circle; the lower half is its conjugate
    scale = np.abs(a).sum(axis=1).max() or 1.0
    radius = max((high - low) / 2, 1e-12 * scale)
    points = (low + high) / 2 + radius * turn
    x = np.random.default_rng(seed).standard_normal((d, size))
    best = None
    for _ in range(ROUNDS):
        q = np.zeros_like(x)
        for z, t, w in zip(points, turn, weights, strict=True):
            q += (w * radius / 2 * t * np.linalg.solve(z * np.eye(d) - a, x)).real
        q, _r = np.linalg.qr(q - known @ (known.T @ q))
        values, turned = np.linalg.eigh(q.T @ a @ q)
        x = q @ turned
        inside = np.flatnonzero((values >= low) & (values < high))
        worst = np.linalg.norm(a @ x[:, inside] - x[:, inside] * values[inside], axis=0).max(initial=0.0) if len(inside) == n else np.inf
        if best is not None and worst >= best[0] / 2 and best[0] <= 1e-12 * scale:
            break
        if best is None or worst < best[0]:
            best = (worst, values[inside], x[:, inside])
    if best is None or not best[0] <= 1e-9 * scale:
        raise ValueError(f"no {n} eigenvalues from {low} to {high} within {ROUNDS} rounds")
    return best[1], best[2]


def top_components(a: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of the symmetric ``a`` in falling order and unit vectors as columns, ``most`` at most, without those that vanish."""
    values, vectors = np.zeros(0), np.zeros((len(a), 0))
    for low, high, n in intervals(a, min(most, len(a))):
        more, x = eigenpairs(a, low, high, n, vectors)
        values, vectors = np.concatenate([values, more]), np.concatenate([vectors, x], axis=1)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > len(a) * 1e-13 * values.max(initial=0.0)]
    return values[order], vectors[:, order]


def _matrix(lists: pa.ListArray) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _on_grid(lists: pa.ListArray) -> np.ndarray:
    """Integers x without the shift that all have."""
    return np.floor(STEPS * _matrix(lists).astype(np.float64)).astype(np.int64)


def _sum_of_products(rows: DataFrame, of, d: int) -> np.ndarray:
    """The sum over all rows of v v', where ``of`` gives a batch's v as rows: a matrix per task, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            v = of(batch)
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])

    parts = rows.mapInArrow(run, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    sums = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("r")).select("i", F.col("r.v").alias("v"))
    total = np.zeros((d, d))
    for r in sums.collect():  # d rows of d numbers
        total[r["i"]] = r["v"]
    return (total + total.T) / 2


def _centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(m, r): the mean is m + r / n, both whole numbers, r the smaller part."""
    m = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(m, np.int64), np.array([s - n * k for s, k in zip(sums, m, strict=True)], np.int64)


def fit(vectors: DataFrame, most: int = MOST) -> Fit | None:
    """Mean and components of the written (vec_id, v) rows of one length; None without rows."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, []
        for batch in batches:
            if batch.num_rows:
                got = _on_grid(batch.column(0)).sum(axis=0).tolist()
                n, sums = n + batch.num_rows, [a + b for a, b in zip(sums or [0] * len(got), got, strict=True)]
        columns = [pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums), pa.int64()), pa.array(map(str, sums), pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "n", "s"])

    parts = vectors.select("v").mapInArrow(add, "i int, n long, s string")
    rows = sorted(parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())  # one per dimension
    if not rows:
        return None
    if len(rows) > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} dimensions")
    n, sums = rows[0]["n"], [int(r["s"]) for r in rows]
    m, r = _centre(n, sums)
    rest = r / n
    v = _sum_of_products(vectors.select("v"), lambda batch: (_on_grid(batch.column(0)) - m) - rest, len(sums)) / n
    values, components = top_components(v, most)
    return Fit(n, [s + n * SHIFT for s in sums], values, components, float(np.trace(v)))


def _deviations(z: np.ndarray, n: int, r: np.ndarray) -> list[str]:
    """For each row the sum of (n * z - r) ** 2, exactly, as text."""
    if n * (float(np.abs(z).max(initial=0)) + 1) < 2**31 / max(1, z.shape[1]) ** 0.5:
        return ((n * z - r) ** 2).sum(axis=1).astype(str).tolist()
    whole = [int(x) for x in r]
    return [str(sum((n * a - b) ** 2 for a, b in zip(row, whole, strict=True))) for row in z.tolist()]


def whiten(rows: DataFrame, vector: str = "embedding", most: int = MOST) -> DataFrame:
    """(vec_id, n, deviation, whitened, explained, identity_error) for each vector that takes part.

    ``deviation`` is a decimal of 38 digits, ``whitened`` and ``explained`` have an entry for each component, by falling eigenvalue.
    """
    spark = rows.sparkSession
    small_batches(spark, 10_000)
    kept = written(rows.where(usable(rows, vector)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("v")), "vectors")
    lengths = kept.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    kept = kept.where(F.size("v") == lengths[0]["d"]) if lengths else kept
    found = fit(kept, most)
    schema = "vec_id long, deviation string, whitened array<double>"
    if found is None or not len(found.values):
        none = kept.limit(0).select("vec_id", F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("deviation"), *(F.array().cast("array<double>").alias(c) for c in ("whitened", "explained")))
        return none.withColumn("identity_error", F.lit(0.0))
    m, r = _centre(found.n, [s - found.n * SHIFT for s in found.sums])
    turn = found.vectors / np.sqrt(found.values)
    n = found.n

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _on_grid(batch.column(1)) - m
            white = (z - r / n) @ turn
            lists = pa.ListArray.from_arrays(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32), white.ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_deviations(z, n, r), pa.string()), lists], names=["vec_id", "deviation", "whitened"])

    white = written(kept.select("vec_id", "v").mapInArrow(project, schema), "whitened")
    k = len(found.values)
    error = float(np.abs(_sum_of_products(white.select("whitened"), lambda batch: _matrix(batch.column(0)), k) / n - np.eye(k)).max())
    shares = F.array(*(F.lit(float(e / found.trace)) for e in found.values))
    return white.select("vec_id", F.lit(n).cast("long").alias("n"), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", shares.alias("explained"), F.lit(error).alias("identity_error"))
