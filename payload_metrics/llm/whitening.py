"""Whitening of embeddings on their leading principal components.

Every entry ``c`` is put on an integer grid, ``x = floor(1024 c) + 100000``, so that counts and sums
over all rows are exact, and a row is centred, ``(n x - S) / n``, before anything is multiplied. The
leading eigenvectors of the covariance are found by Chebyshev-filtered subspace iteration. The
covariance itself is never formed: one pass over the data multiplies it with a block of vectors,
partition by partition, and adds the products up by dimension in one shuffle. Between two
Rayleigh-Ritz steps a Chebyshev polynomial, built by its three-term recurrence from such passes,
damps the unwanted part of the spectrum: it stays below 1 between the smallest Ritz value met and
the smallest of the block, and grows fast above. A lower end met too high lets small eigenvalues
grow, which brings them into the block and lowers that end. QR makes the block orthonormal again.
The iteration ends when the residual ``|V q - e q|`` of every wanted vector certifies it.

What a task and the driver hold is a block of ``dimensions x width`` numbers, whatever the rows.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries are left out;
repeated rows count as often as they stand; an empty table has no rows. Directions without variance
(1e-12 of the largest eigenvalue or less) have no component, so a single vector has none. Of equal
eigenvalues any basis may come. Vectors of different lengths, and entries of 2^40 and more, raise an
error. Other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Columns of the block for each wanted component; the spare ones widen the gap to the rest.
SPARE = 4
#: Highest degree of one filter, and the largest growth it may give the first column over the last.
DEGREE, GROWTH = 24, 1e8
#: Largest residual of a certified vector, as a share of the largest eigenvalue.
CERTIFIED, ACCEPTED = 1e-13, 1e-11
ROUNDS = 200
ENTRIES_AT_ONCE = 1 << 20
LARGEST = float(1 << 40)


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""

    def finite(entry: Column) -> Column:
        return entry.isNotNull() & (F.abs(entry) < F.lit(float("inf")))

    return rows.where(F.col(vector).isNotNull() & F.forall(F.col(vector).cast("array<double>"), finite))


def _grids(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Batch number, first row and grid values, one row per vector, of bounded pieces of batches.

    The vector is the last column.
    """
    for at, batch in enumerate(batches):
        if batch.num_rows == 0:
            continue
        vectors = batch.column(batch.num_columns - 1)
        widths = pc.unique(pc.list_value_length(vectors)).to_pylist()
        if len(widths) > 1:
            raise ValueError(f"vectors of different lengths: {sorted(widths)[:5]}")
        entries = vectors.flatten().to_numpy(zero_copy_only=False)
        if len(entries) and np.abs(entries).max() >= LARGEST:
            raise ValueError(f"vector entries must lie below {LARGEST:.0f}")
        entries = entries.reshape(batch.num_rows, widths[0])
        step = max(ENTRIES_AT_ONCE // max(widths[0], 1), 1)
        for start in range(0, batch.num_rows, step):
            piece = entries[start : start + step]
            yield at, start, np.floor(SCALE * piece).astype(np.int64) + SHIFT


@dataclass(frozen=True)
class Moments:
    """Number of vectors and the exact sum of every dimension."""

    n: int
    sums: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n x - S``, exactly."""
        return self.n * x - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x) / self.n


def moments(vectors: DataFrame) -> Moments:
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for _, _, x in _grids(batches):
            if total is not None and len(total) != x.shape[1]:
                raise ValueError(f"vectors of different lengths: {sorted([len(total), x.shape[1]])}")
            total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
            n += len(x)
        if n:
            yield pa.record_batch({"dim": np.arange(len(total)), "n": np.full(len(total), n), "total": total})

    parts = vectors.mapInArrow(partial, "dim long, n long, total long")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim").collect()
    counts = {row["n"] for row in rows}
    if len(counts) > 1:
        raise ValueError("vectors of different lengths")
    return Moments(counts.pop() if counts else 0, np.array([row["total"] for row in rows], dtype=np.int64))


def covariance_times(vectors: DataFrame, about: Moments, block: np.ndarray) -> np.ndarray:
    """The covariance times a block of vectors, in one pass over the data."""
    dims, width = block.shape
    names = [f"c{j}" for j in range(width)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, _, x in _grids(batches):
            y = about.centred(x)
            product = y.T @ (y @ block)
            total = product if total is None else total + product
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(dims)), *[pa.array(c) for c in total.T]], names=["dim", *names])

    schema = T.StructType([T.StructField("dim", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in names]])
    parts = vectors.mapInArrow(partial, schema)
    rows = parts.groupBy("dim").agg(*[F.sum(c).alias(c) for c in names]).orderBy("dim").collect()
    return np.array([row[1:] for row in rows]) / about.n


def chebyshev(
    apply: Callable[[np.ndarray], np.ndarray],
    block: np.ndarray,
    product: np.ndarray,
    bounds: tuple[float, float],
    top: float,
    degree: int,
) -> np.ndarray:
    """A Chebyshev polynomial of the matrix, applied to ``block``; ``product`` is its first product.

    The polynomial is scaled to 1 at ``top``, so no step overflows.
    """
    centre, half = (bounds[1] + bounds[0]) / 2, (bounds[1] - bounds[0]) / 2
    first = scale = half / (top - centre)
    before, now = block, (product - centre * block) * (scale / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        step = (apply(now) - centre * now) * (2 * following / half)
        before, now, scale = now, step - scale * following * before, following
    return now


def leading_eigenvectors(
    apply: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = 13
) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors as columns, of a positive
    semidefinite matrix known by its products only."""
    width = min(dims, wanted * (1 + SPARE))
    wanted = min(wanted, dims)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    lowest, before = math.inf, math.inf
    for round_ in range(ROUNDS):
        product = apply(block)
        inner = block.T @ product
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, product = block @ turn, product @ turn
        top = float(values[0])
        if top <= 0:
            return np.zeros(0), np.zeros((dims, 0))
        residual = float(np.linalg.norm(product - block * values, axis=0)[:wanted].max()) / top
        if residual <= CERTIFIED or (residual <= ACCEPTED and residual > before / 2):
            held = values[:wanted] > 1e-12 * top
            vectors = block[:, :wanted][:, held]
            largest = np.abs(vectors).argmax(axis=0)
            return values[:wanted][held], vectors * np.sign(vectors[largest, range(vectors.shape[1])])
        before = residual
        high = float(values[-1])
        lowest = min(lowest, max(high, 0.0))
        # The random first block says little about the lower end, so the first filter starts at 0.
        bounds = (0.0 if round_ == 0 else min(lowest, 0.999 * high), max(high, 1e-9 * top))
        reach = (top - sum(bounds) / 2) / ((bounds[1] - bounds[0]) / 2)
        degree = int(math.acosh(GROWTH) / math.acosh(max(reach, 1.0 + 1e-6)))
        block = chebyshev(apply, block, product, bounds, top, max(2, min(DEGREE, degree)))
        block = np.linalg.qr(block)[0]
    raise RuntimeError(f"eigenvectors not certified in {ROUNDS} rounds; residual {before:.1e}")


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector: its centre, the components as columns, their eigenvalues, and how far
    the whitened covariance is from the identity."""

    about: Moments
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.about.centred(x) @ self.vectors / np.sqrt(self.values)


def fit(rows: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> Whitening:
    """The whitening of all usable vectors of ``rows``."""
    vectors = usable(rows, vector).select(F.col(vector).cast("array<double>").alias("vector"))
    about = moments(vectors)
    dims = len(about.sums)
    if not about.n or not dims:
        return Whitening(about, np.zeros(0), np.zeros((dims, 0)), 0.0, 0.0)
    values, found = leading_eigenvectors(lambda block: covariance_times(vectors, about, block), dims, components)
    rough = Whitening(about, values, found, 0.0, 0.0)
    trace, covariance = _whitened_covariance(vectors, rough)
    error = float(np.abs(covariance - np.eye(len(values))).max()) if len(values) else 0.0
    return Whitening(about, values, found, trace, error)


def _whitened_covariance(vectors: DataFrame, whitening: Whitening) -> tuple[float, np.ndarray]:
    """The trace of the covariance of the vectors, and the covariance of the whitened ones."""
    width = len(whitening.values)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + width + width * width)
        for _, _, x in _grids(batches):
            w = whitening.project(x)
            squares = (whitening.about.centred(x) ** 2).sum()
            total += np.concatenate([[squares], w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.record_batch({"at": np.arange(len(total)), "total": total})

    parts = vectors.mapInArrow(partial, "at long, total double")
    sums = np.array([r["total"] for r in parts.groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()])
    sums = sums / whitening.about.n
    mean = sums[1 : 1 + width]
    return float(sums[0]), sums[1 + width :].reshape(width, width) - np.outer(mean, mean)


def whiten(rows: DataFrame, whitening: Whitening, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(row_id, component, n, deviation, whitened, explained, identity_error)``, a row for each
    usable vector and component, numbered from 1 by falling eigenvalue.

    ``deviation``, the exact sum of ``(n x - S)^2`` over the dimensions, is a DECIMAL(38, 0).
    """
    kept = usable(rows, vector).select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    width = len(whitening.values)
    fields = [kept.schema["id"], T.StructField("component", T.IntegerType()), T.StructField("deviation", T.DecimalType(38, 0))]
    schema = T.StructType([*fields, T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType())])
    explained = whitening.values / whitening.trace if width else whitening.values

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not width:
            return
        ids: list[pa.Array] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids[:] = [batch.column(0)]
                yield batch

        for _, start, x in _grids(noted()):
            each = np.repeat(np.arange(len(x)), width)
            columns = [
                ids[0].slice(start, len(x)).take(pa.array(each)),
                pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(x))),
                pa.array(_squares(whitening.about.deviations(x)), pa.decimal128(38, 0)).take(pa.array(each)),
                pa.array(whitening.project(x).ravel()),
                pa.array(np.tile(explained, len(x))),
            ]
            yield pa.record_batch(columns, names=schema.names)

    found = kept.mapInArrow(partial, schema)
    return found.select(
        F.col("id").alias(row_id),
        "component",
        F.lit(whitening.about.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        "explained",
        F.lit(whitening.identity_error).alias("identity_error"),
    )


def _squares(deviations: np.ndarray) -> list[Decimal]:
    """Exact sums of squares of every row."""
    largest = int(np.abs(deviations).max(initial=0))
    if largest * largest * deviations.shape[1] < 1 << 62:
        return [Decimal(v) for v in (deviations * deviations).sum(axis=1).tolist()]
    return [Decimal(v) for v in (deviations.astype(object) ** 2).sum(axis=1)]
