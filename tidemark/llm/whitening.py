"""Whitening of vectors; the covariance's leading eigenvectors come from FEAST contour integration.

Spark makes the counts, sums and the covariance: three passes over narrow arrays, combined within each task before anything
is shuffled. What reaches the driver has the size of the dimension squared, whatever the number of rows.

There the eigenvalues wanted are isolated by inertia: a symmetric factorisation of V - shift has as many positive
pivots as V has eigenvalues above the shift. Bisection on that count gives an interval that holds them. Around the
interval runs a circle; Gauss-Legendre quadrature of solves (zI - V) Q along it filters a random block onto the
eigenvectors inside, Rayleigh-Ritz reads off the pairs, and both are repeated until residuals are at rounding level. The number
found must equal the difference of the inertia counts at the interval's ends, or the block is enlarged and taken anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.workspace import Workspace

#: Whole steps per unit of a vector's entries.
SCALE = 256
COMPONENTS = 4
#: Quadrature points on the upper half of the contour; the lower half mirrors them.
POINTS = 8
ROUNDS = 40


def whole_steps(vector: Column) -> Column:
    """floor(SCALE * c) of each entry as bigint, or null where the vector or an entry is null or not finite."""
    wide = F.transform(vector, lambda c: c.cast("double"))
    sound = vector.isNotNull() & ~F.exists(wide, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.when(F.coalesce(sound, F.lit(False)), F.transform(wide, lambda c: F.floor(F.lit(float(SCALE)) * c).cast("bigint")))


def inertia(a: np.ndarray) -> tuple[int, int]:
    """Numbers of positive and of negative eigenvalues of a symmetric matrix, by symmetric elimination with full pivoting."""
    a = a.copy()
    alpha = (1 + np.sqrt(17)) / 8  # balances the growth of one-row and two-row pivots
    positive = negative = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        r = int(diagonal.argmax())
        if len(a) == 1 or diagonal[r] >= alpha * np.abs(a).max():
            pivot = a[r, r]
            if pivot == 0:
                break
            positive, negative = positive + (pivot > 0), negative + (pivot < 0)
            rest = np.delete(np.arange(len(a)), r)
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, r], a[r, rest]) / pivot
        else:
            p, q = np.unravel_index(np.abs(a - np.diag(np.diag(a))).argmax(), a.shape)
            pair = [int(p), int(q)]
            # Such a block has a negative determinant: one eigenvalue on either side.
            positive, negative = positive + 1, negative + 1
            rest = np.delete(np.arange(len(a)), pair)
            a = a[np.ix_(rest, rest)] - a[np.ix_(rest, pair)] @ np.linalg.solve(a[np.ix_(pair, pair)], a[np.ix_(pair, rest)])
        a = (a + a.T) / 2
    return int(positive), int(negative)


def above(v: np.ndarray, shift: float) -> int:
    return inertia(v - shift * np.eye(len(v)))[0]


def isolated(v: np.ndarray, k: int) -> tuple[float, float, int]:
    """An interval (low, high) of the leading eigenvalues, and their number: k, or more where they stand too close to part."""
    high = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-6)
    low, beyond, inside = -high, high, len(v)
    # From below with too many inside, from above with too few; stop where k are parted from the next, or nothing is left to part.
    for _ in range(60):
        middle = (low + beyond) / 2
        count = above(v, middle)
        if count >= k:
            low, inside = middle, count
        else:
            beyond = middle
        if inside == k and _distinct(v, low, k) or beyond - low < 1e-9 * high:
            break
    # An eigenvalue within rounding of the lower end, above or below it (as a zero one of a flat covariance at 0), is
    # neither in nor out for the filter: the end moves down past it, taking it in. Each step passes one at least.
    margin = 1e-9 * high
    while low > -high and above(v, low - margin) != above(v, low + margin):
        low = max(low - 2 * margin, -high)
    return low, high, above(v, low)


def _distinct(v: np.ndarray, low: float, k: int) -> bool:
    """Nothing lies just below the interval, so that the filter parts its ends well."""
    return above(v, low - 1e-3 * max(abs(low), 1e-300)) == k


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Of equal eigenvalues any orthonormal vectors are taken. A vector's sign makes its largest entry positive.
    """
    size, k = len(v), min(k, len(v))
    scale = float(np.abs(v).max())
    if scale == 0:
        return np.zeros(k), np.eye(size)[:, :k]
    v = v / scale
    low, high, inside = isolated(v, k)
    block = min(size, inside + max(4, inside // 2))
    while True:
        values, vectors = _feast(v, low, high, block)
        if len(values) == inside:
            break
        if block == size:
            raise ArithmeticError(f"{len(values)} eigenpairs found in an interval that holds {inside}")
        block = min(size, 2 * block)
    order = np.argsort(-values, kind="stable")[:k]
    values, vectors = values[order], vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return values * scale, vectors * signs


def _feast(v: np.ndarray, low: float, high: float, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of ``v`` inside (low, high) that a block of so many vectors settles."""
    size, centre, radius = len(v), (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    angles = np.pi * (nodes + 1) / 2
    shifts = centre + radius * np.exp(1j * angles)
    # Along z(t) = centre + radius e^{it}; the two halves of the circle are conjugate, so twice the real part of one remains.
    factors = weights / 2 * radius * np.exp(1j * angles)
    solvers = [np.linalg.inv(z * np.eye(size) - v) for z in shifts]
    y = np.random.default_rng(7).standard_normal((size, block))
    norm, best = float(np.abs(v).sum(axis=1).max()), np.inf
    for _ in range(ROUNDS):
        q = sum((f * (s @ y)).real for f, s in zip(factors, solvers))
        # Rayleigh-Ritz on the filtered space; directions the filter has emptied drop out.
        u, sigma, _ = np.linalg.svd(q, full_matrices=False)
        basis = u[:, sigma > 1e-13 * sigma[0]]
        reduced = basis.T @ v @ basis
        values, small = np.linalg.eigh((reduced + reduced.T) / 2)
        vectors = basis @ small
        within = (values > low) & (values < high)
        residual = np.linalg.norm(v @ vectors - vectors * values, axis=0)
        worst = float(residual[within].max(initial=0)) / norm
        if worst < 1e-15 * size or worst >= best * 0.5 and worst < 1e-11:
            break
        best = min(best, worst)
        y = vectors
    settled = within & (residual < 1e-10 * norm)
    return values[settled], vectors[:, settled]


@dataclass(frozen=True)
class Model:
    """What whitening needs: count and sums of the fit list (exact), eigenpairs, the covariance's trace."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _summed(partials: DataFrame) -> DataFrame:
    """``at``, ``total`` of arrays ``part``, place by place; the arrays of a task were added up before."""
    return partials.select(F.posexplode("part").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("total"))


def _moments(x: DataFrame, size: int, centre: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The covariance, divisor n, of (x - centre) @ vectors over all rows; ``centre`` is the mean up to rounding."""
    wide = vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squares, first, n = np.zeros((wide, wide)), np.zeros(wide), 0
        for batch in batches:
            y = (_matrix(batch.column("x"), size) - centre) @ vectors
            squares, first, n = squares + y.T @ y, first + y.sum(axis=0), n + len(y)
        part = np.concatenate([squares.ravel(), first, [n]])
        yield pa.RecordBatch.from_arrays([pa.array([part.tolist()], pa.list_(pa.float64()))], names=["part"])

    total = np.zeros(wide * wide + wide + 1)
    for row in _summed(x.select("x").mapInArrow(run, "part array<double>")).toLocalIterator():
        total[row["at"]] = row["total"]
    n = max(total[-1], 1.0)
    mean = total[wide * wide:-1] / n
    return total[:wide * wide].reshape(wide, wide) / n - np.outer(mean, mean)


def _sums(x: DataFrame, size: int) -> tuple[int, tuple[int, ...]]:
    """Rows and the exact sum of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Two halves of each number are added apart: neither can leave 64 bits.
        high, low, n = np.zeros(size, object), np.zeros(size, object), 0
        for batch in batches:
            m = _matrix(batch.column("x"), size)
            high, low, n = high + (m >> 32).sum(axis=0).astype(object), low + (m & 0xFFFFFFFF).sum(axis=0).astype(object), n + len(m)
        part = [int(h) * (1 << 32) + int(l) for h, l in zip(high, low)] + [n]
        yield pa.RecordBatch.from_arrays([pa.array([[str(p) for p in part]], pa.list_(pa.string()))], names=["part"])

    parts = x.select("x").mapInArrow(run, "part array<string>").select(F.col("part").cast("array<decimal(38,0)>").alias("part"))
    total = {row["at"]: int(row["total"]) for row in _summed(parts).toLocalIterator()}
    return total.get(size, 0), tuple(total.get(i, 0) for i in range(size))


def usual_size(vectors: DataFrame) -> int:
    """The most frequent number of entries, the larger of equally frequent ones; 0 without vectors."""
    sizes = vectors.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    return first["size"] if first else 0


def fit(distinct: DataFrame, size: int, components: int = COMPONENTS) -> Model:
    """The model of a list of vectors ``x`` (arrays of ``size`` bigints, none null), each counting once per row."""
    n, sums = _sums(distinct, size)
    mean = np.array([s / max(n, 1) for s in sums])
    v = _moments(distinct, size, mean, np.eye(size))
    v = (v + v.T) / 2
    values, vectors = leading(v, components)
    trace = float(np.trace(v))
    # Directions without spread beyond rounding cannot be scaled to one.
    usable = values > 1e-12 * max(trace, 1e-300)
    return Model(n, sums, values[usable], vectors[:, usable], trace)


def whitened(rows: DataFrame, model: Model) -> DataFrame:
    """``row`` and arrays ``deviation`` (one value) and ``whitened`` (a value per component) of rows ``row``, ``x``."""
    size, n, sums = len(model.sums), model.n, model.sums
    mean, project = model.mean, model.vectors / np.sqrt(model.values)
    bound = max(map(abs, sums), default=0)
    schema = f"row {rows.schema['row'].dataType.simpleString()}, deviation string, whitened array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), size)
            most = n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + bound
            if most * most * size < 1 << 63:
                apart = n * x - np.array(sums, np.int64)
                deviation = (apart * apart).sum(axis=1).tolist()
            else:
                deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x.tolist()]
            y = (x - mean) @ project
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([str(d) for d in deviation], pa.string()), pa.array(y.tolist(), pa.list_(pa.float64()))],
                names=["row", "deviation", "whitened"],
            )

    return rows.select("row", "x").mapInArrow(run, schema)


def whiten(vectors: DataFrame, vector: str, space: Workspace, components: int = COMPONENTS) -> DataFrame:
    """``row`` (every input column), ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    One row per vector and component, components numbered from 1 by falling eigenvalue. Rows whose vector is null or
    holds null, NaN or infinite entries are left out, and so are vectors that have another number of entries than most
    (of equally frequent numbers the larger; none if that is 0). The fit list has each distinct vector of whole steps once, so copies weigh nothing;
    the rows themselves all come back, repeated ones and null ids too. Directions without any spread (a list of equal vectors, fewer vectors
    than dimensions) give no component. Equal eigenvalues take any orthonormal vectors, the same for all rows. ``deviation``
    is exact, a decimal of 38 digits, null beyond. An empty table gives no rows. Other columns may have any names.
    """
    spark = space.spark
    packed = vectors.select(F.struct(*[F.col(f"`{c}`") for c in vectors.columns]).alias("row"))
    whole = packed.select("row", whole_steps(F.col(f"row.`{vector}`")).alias("x")).filter("x is not null")
    distinct = space.keep(whole.groupBy("x").agg(F.count("*").alias("copies")).select("x"), "distinct")
    size = usual_size(whole)
    distinct, whole = distinct.filter(F.size("x") == size), whole.filter(F.size("x") == size)
    model = fit(distinct, size, components) if size > 0 else Model(0, (), np.zeros(0), np.zeros((0, 0)), 0.0)
    count = len(model.values)
    if not count:
        return _listed(spark, packed.select("row", F.lit("0").alias("deviation"), F.array().cast("array<double>").alias("whitened")).limit(0), model, 0.0)
    covariance = _moments(distinct, size, model.mean, model.vectors / np.sqrt(model.values))
    error = float(np.abs(covariance - np.eye(count)).max())
    return _listed(spark, whitened(whole, model), model, error)


def _listed(spark: SparkSession, rows: DataFrame, model: Model, error: float) -> DataFrame:
    explained = [float(e / model.trace) for e in model.values]
    return rows.select(
        "row", F.expr("try_cast(deviation as decimal(38,0))").alias("deviation"), F.posexplode("whitened").alias("_at", "whitened")
    ).select(
        "row", (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(F.array(*[F.lit(e) for e in explained]).cast("array<double>"), F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
