"""Embedding whitening by spectrum slicing.

Entries become whole numbers, so that the sums, the centred second moments and the deviation of
a row are exact and do not depend on how rows are dealt to tasks. Three passes over the vectors
gather the sums, the second moments about the rounded mean, and the covariance of the whitened
rows; a task sends one row of ``dims ** 2`` numbers at most, whatever the number of vectors.

The driver holds one matrix of ``dims ** 2`` numbers. There the LDL^T factors of the shifted
covariance tell how many eigenvalues lie above a shift (Sylvester's law of inertia): bisection by
these counts isolates each of the leading eigenvalues, Rayleigh quotient iteration inside its
interval converges cubically, and counts on both sides certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Intervals of this share of the trace are not cut further; eigenvalues that share one form a cluster.
CLUSTER = 1e-11
RESULT = (
    "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
)
_ALPHA = (1 + 17**0.5) / 8


def usable(column: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite numbers."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(finite & (F.size(column) > 0), F.lit(False))


def whole_numbers(batch: pa.RecordBatch, name: str = "vector") -> np.ndarray:
    """The vectors of a batch as rows of ``floor(SCALE * entry) + SHIFT``."""
    column = batch.column(batch.schema.get_field_index(name))
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    return np.floor(SCALE * values.reshape(len(column), -1)).astype(np.int64) + SHIFT


def exact_gram(rows: np.ndarray) -> np.ndarray:
    """``rows.T @ rows`` of whole numbers, exact: by floating point where no sum can round."""
    most = int(np.abs(rows).max(initial=0)) ** 2 * len(rows)
    if most < 1 << 53:
        return np.rint(rows.T.astype(np.float64) @ rows.astype(np.float64)).astype(np.int64).astype(object)
    if most < 1 << 63:
        return (rows.T @ rows).astype(object)
    return rows.T.astype(object) @ rows.astype(object)


def positive_count(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``matrix`` exceed ``shift``.

    The signs of D in the LDL^T factors of the shifted matrix, with pivots of one or two rows
    chosen from the whole rest, so that the factors stay bounded.
    """
    a = matrix - shift * np.eye(len(matrix))
    count, at, n = 0, 0, len(a)
    while at < n:
        rest = a[at:, at:]
        size = np.abs(rest)
        diagonal = size.diagonal().copy()
        p = int(diagonal.argmax())
        np.fill_diagonal(size, 0)
        q, r = divmod(int(size.argmax()), n - at)
        off = size[q, r]
        if diagonal[p] >= _ALPHA * off:
            if p:
                rest[[0, p]] = rest[[p, 0]]
                rest[:, [0, p]] = rest[:, [p, 0]]
            pivot = rest[0, 0]
            count += pivot > 0
            if pivot:
                rest[1:, 1:] -= np.outer(rest[1:, 0] / pivot, rest[0, 1:])
            at += 1
        else:
            q, r = min(q, r), max(q, r)
            for here, there in ((0, q), (1, r)):
                if here != there:
                    rest[[here, there]] = rest[[there, here]]
                    rest[:, [here, there]] = rest[:, [there, here]]
            # A block with a negative determinant has one eigenvalue of each sign.
            block = rest[:2, :2].copy()
            determinant = block[0, 0] * block[1, 1] - block[0, 1] ** 2
            count += 1 if determinant < 0 else 2 * (block[0, 0] > 0)
            rest[2:, 2:] -= rest[2:, :2] @ np.linalg.solve(block, rest[:2, 2:])
            at += 2
    return count


def _converged(matrix: np.ndarray, low: float, high: float, found: list[np.ndarray], seed: int) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from the middle of an interval, away from the vectors ``found``."""
    n, basis = len(matrix), np.array(found).reshape(-1, len(matrix))
    scale = np.abs(matrix).max()

    def apart(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - basis.T @ (basis @ v)
        return v / np.linalg.norm(v)

    def solved(shift: float, v: np.ndarray) -> np.ndarray:
        for tiny in (0.0, 1e-16, 1e-14):
            try:
                out = np.linalg.solve(matrix - (shift + tiny * scale) * np.eye(n), v)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(out).all():
                return out
        return v

    v = apart(np.random.default_rng(seed).standard_normal(n))
    shift = (low + high) / 2
    for _ in range(3):
        v = apart(solved(shift, v))
    value = float(v @ matrix @ v)
    for _ in range(12):
        if not low <= value <= high:
            break
        v = apart(solved(value, v))
        before, value = value, float(v @ matrix @ v)
        if np.linalg.norm(matrix @ v - value * v) <= 4 * n * np.finfo(float).eps * scale and abs(value - before) <= 1e-14 * scale:
            break
    return value, v


def leading_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and unit vectors as rows."""
    n = len(matrix)
    k = min(k, n)
    trace = float(np.trace(np.abs(matrix)))
    if not k or not trace:
        return np.zeros(k), np.eye(n)[:k]
    slack = n * np.finfo(float).eps * trace
    bound = float(np.abs(matrix).sum(axis=1).max()) + slack
    known = {-bound: n, bound: 0}

    def above(shift: float) -> int:
        if shift not in known:
            known[shift] = positive_count(matrix, shift)
        return known[shift]

    def narrowed(number: int, width: float) -> tuple[float, float]:
        """Shifts of which at least ``number`` and fewer than ``number`` eigenvalues are above."""
        low = max(s for s, c in known.items() if c >= number)
        high = min(s for s, c in known.items() if c < number and s > low)
        while high - low > width and not (known[low] == number and known[high] == number - 1):
            middle = (low + high) / 2
            if above(middle) >= number:
                low = middle
            else:
                high = middle
        return low, high

    values, vectors = [], []
    for number in range(1, k + 1):
        low, high = narrowed(number, CLUSTER * trace)
        while True:
            value, vector = _converged(matrix, low, high, vectors, number)
            # Not more than ``number - 1`` above, and at least ``number`` above or at it: the number is certain.
            width = max(slack, 1e-13 * abs(value))
            inside = low - width <= value <= high + width
            if inside and above(value + width) < number <= above(value - width):
                break
            if high - low <= slack:
                raise ArithmeticError(f"eigenvalue {number} could not be separated")
            middle = (low + high) / 2
            low, high = (middle, high) if above(middle) >= number else (low, middle)
        values.append(value)
        vectors.append(vector)
    return np.array(values), np.array(vectors)


@dataclass(frozen=True)
class Whitening:
    """What whitening needs of the fit list: count, sums, components and their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def center(self) -> np.ndarray:
        """The whole numbers next to the mean, from which entries are counted."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> list[int]:
        """``n`` times what the mean exceeds the center by."""
        return [s - self.n * int(c) for s, c in zip(self.sums, self.center, strict=True)]

    def positive(self) -> np.ndarray:
        """Components with an eigenvalue above what rounding leaves; the others have no whitened value."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.trace, 0.0)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of the whole-number rows ``x``; NaN for components without variance."""
        centred = (x - self.center) - np.array(self.rest, dtype=np.float64) / self.n
        scale = np.where(self.positive(), self.values, np.nan)
        return (centred @ self.vectors.T) / np.sqrt(scale)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Per row the exact sum over dimensions of ``(n * x - S) ** 2``."""
        y, rest = x - self.center, self.rest
        if (int(np.abs(y).max(initial=0)) + max(map(abs, rest), default=0)) ** 2 * max(1, len(rest)) >= 1 << 62:
            y = y.astype(object)
        squares, crossed = (y * y).sum(axis=1), (y * np.array(rest, dtype=y.dtype)).sum(axis=1)
        constant = sum(r * r for r in rest)
        return [self.n * (self.n * int(a) - 2 * int(b)) + constant for a, b in zip(squares, crossed, strict=True)]


def _vectors(vectors: DataFrame, column: str, key: str) -> DataFrame:
    kept = vectors.filter(usable(F.col(column)))
    return kept.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))


def _added(rows: DataFrame, kind: str) -> list:
    """Sums over tasks of their arrays ``parts``, place by place."""
    places = rows.select(F.posexplode("parts").alias("place", "part"))
    added = places.groupBy("place").agg(F.sum(F.col("part").cast(kind)).alias("total")).collect()
    return [r["total"] for r in sorted(added, key=lambda r: r["place"])]


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding", key: str = "vec_id") -> Whitening | None:
    """The whitening of all usable vectors; None if there are none.

    All usable vectors must have one length, which is an error otherwise. Repeated rows count as
    often as they stand. The driver receives ``dims * (dims + 3) / 2`` numbers.
    """
    rows = _vectors(vectors, column, key).select("vector")
    lengths = [r[0] for r in rows.select(F.size("vector")).distinct().limit(2).collect()]
    if not lengths:
        return None
    if len(lengths) > 1:
        raise ValueError("the vectors are of several lengths")
    dims = lengths[0]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dims + 1, dtype=object)
        for batch in batches:
            x = whole_numbers(batch)
            total += np.concatenate(([len(x)], (x - SHIFT).sum(axis=0)))
        yield pa.record_batch([pa.array([[Decimal(int(t)) for t in total]], pa.list_(pa.decimal128(38, 0)))], names=["parts"])

    n, *moved = (int(t) for t in _added(rows.mapInArrow(sums, "parts array<decimal(38,0)>"), "decimal(38,0)"))
    plain = Whitening(n, tuple(s + n * SHIFT for s in moved), np.zeros(0), np.zeros((0, dims)), 0.0)
    center, upper = plain.center, np.triu_indices(dims)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), dtype=object)
        for batch in batches:
            total += exact_gram(whole_numbers(batch) - center)
        parts = [Decimal(int(t)) for t in total[upper]]
        yield pa.record_batch([pa.array([parts], pa.list_(pa.decimal128(38, 0)))], names=["parts"])

    second = _added(rows.mapInArrow(moments, "parts array<decimal(38,0)>"), "decimal(38,0)")
    covariance, rest = np.zeros((dims, dims)), plain.rest
    for i, j, value in zip(*upper, second, strict=True):
        covariance[i, j] = covariance[j, i] = float(Fraction(n * int(value) - rest[i] * rest[j], n * n))
    values, found = leading_eigenpairs(covariance, components)
    return Whitening(n, plain.sums, values, found, float(np.trace(covariance)))


def identity_error(vectors: DataFrame, fitted: Whitening, column: str = "embedding", key: str = "vec_id") -> float:
    """The largest entry, in size, of the covariance of the whitened fit list minus the identity.

    Components without variance are left out; with none left the error is 0.
    """
    kept = np.flatnonzero(fitted.positive())
    k = len(kept)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            w = fitted.project(whole_numbers(batch))[:, kept]
            total += np.concatenate((w.sum(axis=0), (w.T @ w).ravel()))
        yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["parts"])

    rows = _vectors(vectors, column, key).select("vector")
    total = np.array(_added(rows.mapInArrow(run, "parts array<double>"), "double")) / fitted.n
    mean = total[:k]
    return float(np.abs(total[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """One row of ``RESULT`` for each usable row of ``vectors`` and each leading component.

    Rows whose vector is NULL, empty, or holds a NULL or non-finite entry are left out. Repeated
    rows and ids stay, a NULL id stays NULL, other columns are ignored, no usable rows give no
    rows. ``explained`` is the component's share of the trace. Where the vectors have no variance
    left, ``whitened`` is NULL and ``explained`` 0. Equal eigenvalues have any orthogonal vectors.
    """
    spark = vectors.sparkSession
    fitted = fit_whitening(vectors, components, column, key)
    if fitted is None:
        return spark.createDataFrame([], RESULT)
    error = identity_error(vectors, fitted, column, key)
    k = len(fitted.values)
    explained = np.where(fitted.positive(), fitted.values / (fitted.trace or 1.0), 0.0)
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole_numbers(batch)
            m, whitened = len(x), fitted.project(x).ravel()
            each = pa.array(np.repeat(np.arange(m), k))
            deviation = pa.array([Decimal(d) for d in fitted.deviation(x)], pa.decimal128(38, 0))
            yield pa.record_batch(
                [
                    batch.column(0).take(each),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, fitted.n)),
                    deviation.take(each),
                    pa.array(whitened, mask=np.isnan(whitened)),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=names,
            )

    return _vectors(vectors, column, key).mapInArrow(run, RESULT)
