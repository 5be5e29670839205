"""Embedding whitening by contour integration of the covariance (FEAST).

Entries become whole numbers, so counts, sums and the covariance are exact, whatever the order in
which tasks end. The spectrum is cut into slices by inertia counts. A slice is one
Spark task: the solves ``(z I - V)^-1 Y`` at quadrature nodes of a circle around it project
random vectors onto its eigenvectors, Rayleigh-Ritz extracts these, and the inertia count says
whether any is missing. A last Rayleigh-Ritz over all slices makes the components orthonormal.

Only matrices of the vectors' dimension pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
#: Fixed values of the whole numbers: ``floor(STEP * c) + SHIFT``.
STEP, SHIFT = 64, 1_000_000
#: Eigenvalues of a slice, if they are not too close to cut there; nodes of a half circle; rounds at most.
SLICE, NODES, ROUNDS = 8, 8, 24
#: Gap between slices relative to the eigenvalues there; residual of a component relative to the largest.
GAP, RESIDUAL = 1e-6, 1e-13

_LIMB = 20
_NUMBER = pa.decimal128(38, 0)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors without null or non-finite entries, as whole numbers, of the most frequent length.

    Of lengths equally frequent the longest is taken. Entries have to be below 2^40 in size.
    """
    own = F.col(column)
    finite = F.forall(own, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.select("vec_id", F.when(own.isNotNull() & finite, own).alias("c")).where("c IS NOT NULL AND size(c) > 0")
    lengths = rows.groupBy(F.size("c").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    x = F.transform("c", lambda c: F.floor(c.cast("double") * STEP).cast("long") + SHIFT)
    return rows.where(F.size("c") == (first["size"] if first else 0)).select("vec_id", x.alias("x"))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimension)


def gram(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of whole numbers as Python integers, by exact products of doubles."""
    most = int(np.abs(y).max(initial=0))
    total = np.zeros((y.shape[1], y.shape[1]), object)
    if most < 1 << (_LIMB + 1):
        rows = max(1, (1 << 53) // max(1, most * most))
        for at in range(0, len(y), rows):
            part = y[at : at + rows].astype(np.float64)
            total += (part.T @ part).astype(np.int64).astype(object)
        return total
    high = y >> _LIMB
    low = y - (high << _LIMB)
    both = gram(high + low) - gram(high) - gram(low)
    return (gram(high) << (2 * _LIMB)) + (both << _LIMB) + gram(low)


def moments(rows: DataFrame, center: list[int]) -> tuple[int, list[int], np.ndarray]:
    """n, the sums and the matrix of products of ``x - center`` over all rows, exact."""
    dimension, middle = len(center), np.array(center, np.int64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, product = 0, np.zeros(dimension, object), np.zeros((dimension, dimension), object)
        for batch in batches:
            y = _matrix(batch.column(0), dimension) - middle
            n += len(y)
            total += y.sum(axis=0).astype(object)
            product += gram(y)
        if n:
            lines = [[n, *total], *product]
            values = pa.array([[Decimal(int(v)) for v in line] for line in lines], pa.list_(_NUMBER))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(lines)), pa.int32()), values], names=["line", "numbers"])

    parts = rows.select("x").mapInArrow(sums, "line int, numbers array<decimal(38,0)>")
    parts = parts.select("line", F.posexplode("numbers").alias("place", "number")).where("line = 0 OR place >= line - 1")
    lines = parts.groupBy("line", "place").agg(F.sum("number").cast("string").alias("number")).collect()  # half a matrix
    n, total, product = 0, [0] * dimension, np.zeros((dimension, dimension), object)
    for line, place, number in lines:
        if line:
            product[line - 1, place] = product[place, line - 1] = int(number)
        elif place:
            total[place - 1] = int(number)
        else:
            n = int(number)
    return n, total, product


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonals of a tridiagonal matrix with the eigenvalues of a symmetric one, by reflections."""
    a = matrix.copy()
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if size > 0:
            v[0] += np.copysign(size, v[0])
            v /= np.linalg.norm(v)
            a[k + 1 :, :] -= 2 * np.outer(v, v @ a[k + 1 :, :])
            a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def inertia(diagonals: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Eigenvalues above ``shift``: the positive pivots of the shifted matrix's L D L'."""
    diagonal, beside = diagonals
    least = np.finfo(float).tiny / np.finfo(float).eps
    above, pivot = 0, 1.0
    for i, value in enumerate(diagonal):
        pivot = value - shift - (beside[i - 1] ** 2 / pivot if i else 0.0)
        pivot = pivot if abs(pivot) > least else -least
        above += pivot > 0
    return above


def _edge(diagonals, many: int, low: float, high: float, width: float) -> tuple[float, float]:
    """Two points at most ``width`` apart: above the upper one are fewer than ``many`` eigenvalues, above the lower as many."""
    while high - low > width:
        middle = (low + high) / 2
        if inertia(diagonals, middle) >= many:
            low = middle
        else:
            high = middle
    return low, high


def spectrum(matrix: np.ndarray, components: int, size: int = SLICE) -> list[tuple[float, float, int]]:
    """Slices (low, high, eigenvalues in it) from the top down that hold the first ``components`` positive eigenvalues."""
    if not matrix.any():
        return []
    diagonals = tridiagonal(matrix)
    beside = np.concatenate([[0], np.abs(diagonals[1]), [0]])
    top = float((diagonals[0] + beside[1:] + beside[:-1]).max()) * (1 + 1e-9)
    floor = 16 * len(matrix) * np.finfo(float).eps * top
    positive = inertia(diagonals, floor)
    slices, done, high = [], 0, top
    while done < min(components, positive):
        for many in range(min(done + size, positive), positive + 1):
            if many == positive:
                cut, wide = floor, np.inf
            else:
                upper = _edge(diagonals, many, floor, high, GAP * high / 4)[0]
                lower = _edge(diagonals, many + 1, floor, high, GAP * high / 4)[1]
                cut, wide = (upper + lower) / 2, upper - lower
            if wide > GAP * high and inertia(diagonals, cut) == many:
                break
        slices.append((float(cut), float(high), many - done))
        done, high = many, cut
    return slices


def contour(matrix: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues between ``low`` and ``high`` with their vectors, by quadrature on a circle."""
    size, scale = len(matrix), np.abs(matrix).sum(axis=1).max()
    center, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(0.5j * np.pi * (1 - nodes))
    random = np.random.default_rng(seed)
    basis = random.standard_normal((size, min(size, 2 * count + 8)))
    identity = np.eye(size)
    for _ in range(ROUNDS):
        # The integral over the upper half of the circle; the lower half is its conjugate.
        found = sum(
            w / 2 * (radius * t * np.linalg.solve((center + radius * t) * identity - matrix, basis)).real
            for w, t in zip(weights, turn, strict=True)
        )
        u, s, _ = np.linalg.svd(found, full_matrices=False)
        u = u[:, s > s[0] * 1e-14]
        values, rotation = np.linalg.eigh(u.T @ matrix @ u)
        basis = u @ rotation
        own = np.flatnonzero((values > low) & (values <= high))
        rest = np.linalg.norm(matrix @ basis[:, own] - basis[:, own] * values[own], axis=0)
        own_found = own[rest <= RESIDUAL * scale * size**0.5]
        if len(own_found) == count == len(own):
            return values[own], basis[:, own]
        # A vector outside may still be mixed with one inside; rounds go on with a basis of full width.
        if basis.shape[1] < min(size, 2 * count + 8):
            basis = np.hstack([basis, random.standard_normal((size, min(size, 2 * count + 8) - basis.shape[1]))])
    raise RuntimeError(f"{len(own_found)} of {count} eigenvalues found between {low} and {high}")


def components(rows: DataFrame, matrix: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of ``matrix``, falling, and their unit vectors as columns; slices are Spark tasks.

    ``rows`` only gives the session. Eigenvalues that are zero but for rounding are no components.
    """
    slices = spectrum(matrix, most)
    if not slices:
        return np.zeros(0), np.zeros((len(matrix), 0))
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(matrix)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, count in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "count")), strict=True):
                vectors = contour(shared.value, low, high, count)[1]
                yield pa.RecordBatch.from_arrays([pa.array(vectors.T.tolist(), pa.list_(pa.float64()))], names=["vector"])

    table = spark.createDataFrame(slices, "low double, high double, count int").repartition(len(slices), "low")
    vectors = np.array([r.vector for r in table.mapInArrow(solve, "vector array<double>").collect()]).T
    basis = np.linalg.qr(vectors)[0]
    values, rotation = np.linalg.eigh(basis.T @ matrix @ basis)
    order = np.argsort(-values)[:most]
    vectors = basis @ rotation[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1, 1)
    return values[order], vectors


class Whitening:
    """What was fitted: count, sums, components and their eigenvalues."""

    def __init__(self, rows: DataFrame, most: int = COMPONENTS):
        first = rows.first()
        self.dimension = len(first["x"]) if first else 0
        self.n, total, _ = moments(rows, [SHIFT] * self.dimension) if first else (0, [], None)
        self.sums = [int(s) + self.n * SHIFT for s in total]
        self.center = [round(s / self.n) for s in self.sums]
        self.rest, self.values, self.vectors, self.trace = [], np.zeros(0), np.zeros((self.dimension, 0)), 0.0
        if not first:
            return
        n, rest, product = moments(rows, self.center)
        if n != self.n:
            raise RuntimeError("the vectors changed between two scans")
        self.rest = rest
        # n^2 V, in whole numbers; a quotient of Python integers is rounded once.
        exact = n * product - np.outer(np.array(rest, object), np.array(rest, object))
        matrix = np.array([[v / (n * n) for v in line] for line in exact], np.float64)
        self.trace = int(np.trace(exact)) / (n * n)
        self.values, self.vectors = components(rows, matrix, most)

    def _whitened(self, y: np.ndarray) -> np.ndarray:
        mean = np.array([r / self.n for r in self.rest])
        return (y - mean) @ self.vectors / np.sqrt(self.values)

    def apply(self, rows: DataFrame) -> DataFrame:
        """(vec_id, deviation decimal, whitened array) of vectors as ``usable`` gives them."""
        dimension, middle, rest, n, whitened = self.dimension, np.array(self.center, np.int64), self.rest, self.n, self._whitened

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y = _matrix(batch.column("x"), dimension) - middle
                own = whitened(y)
                most = (n * int(np.abs(y).max(initial=0)) + max(map(abs, rest), default=0)) ** 2 * dimension
                kind = np.int64 if most < 1 << 62 else object
                apart = ((n * y.astype(kind) - np.array(rest, kind)) ** 2).sum(axis=1)
                arrays = [batch.column("vec_id"), pa.array([Decimal(int(a)) for a in apart], _NUMBER)]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(own.ravel()), own.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*arrays, lists], names=["vec_id", "deviation", "whitened"])

        kind = rows.schema["vec_id"].dataType.simpleString()
        return rows.mapInArrow(apply, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")

    def identity_error(self, rows: DataFrame) -> float:
        """Largest absolute entry of the whitened vectors' covariance minus the identity, measured on all of them."""
        dimension, middle, whitened, many = self.dimension, np.array(self.center, np.int64), self._whitened, len(self.values)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, product = np.zeros(many), np.zeros((many, many))
            for batch in batches:
                z = whitened(_matrix(batch.column(0), dimension) - middle)
                total += z.sum(axis=0)
                product += z.T @ z
            lines = [total, *product]
            values = pa.array([line.tolist() for line in lines], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(lines)), pa.int32()), values], names=["line", "numbers"])

        parts = rows.select("x").mapInArrow(sums, "line int, numbers array<double>")
        parts = parts.select("line", F.posexplode("numbers").alias("place", "number"))
        found = np.zeros((many + 1, many))
        for line, place, number in parts.groupBy("line", "place").agg(F.sum("number")).collect():  # a small matrix
            found[line, place] = number
        mean = found[0] / self.n
        return float(np.abs(found[1:] / self.n - np.outer(mean, mean) - np.eye(many)).max())


def whiten(vectors: DataFrame, most: int = COMPONENTS, deviation: Column | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each usable vector and component.

    Dropped are vectors that are null, empty, hold null or non-finite entries, or are not as
    long as most are. Repeated rows and ids stay, each for itself. Components without variance are
    none, so equal vectors, a single one, and an empty table give no rows. Of equal eigenvalues
    the components are some orthonormal basis, the same for all rows. ``deviation`` is a decimal
    unless another expression of it is given; other columns are dropped.
    """
    rows = usable(vectors)
    fitted = Whitening(rows, most)
    if not len(fitted.values):
        error, explained = 0.0, F.array().cast("array<double>")
    else:
        error, explained = fitted.identity_error(rows), F.array(*[F.lit(float(v / fitted.trace)) for v in fitted.values])
    applied = fitted.apply(rows) if len(fitted.values) else rows.select("vec_id", F.lit(0).cast("decimal(38,0)").alias("deviation"), explained.alias("whitened"))
    each = applied.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        (F.col("deviation") if deviation is None else deviation).alias("deviation"),
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def report(vectors: DataFrame) -> DataFrame:
    """``whiten`` with deviations as longs, null where one does not fit."""
    return whiten(vectors, deviation=F.expr("try_cast(deviation AS bigint)"))
