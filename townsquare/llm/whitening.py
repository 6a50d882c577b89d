"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Entries become whole numbers, so that counts, sums and the centred scatter are
exact and do not depend on how the rows are laid out.

1. One pass counts the vectors and sums each dimension.
2. The next centres each vector on the whole number nearest to the mean, multiplies,
   and adds up; what is left of the mean, half a unit at most, is taken off exactly.
3. On the driver, which holds dimensions x dimensions numbers: Cholesky of the
   covariance, the largest remaining diagonal first, until nothing is left; then
   one-sided Jacobi rotates the columns of the triangular factor until they are
   orthogonal. Their squared norms are the eigenvalues, the normalised columns the
   components. The covariance itself is never rotated.
4. Each vector is projected. A last pass measures how far the covariance of the
   projections is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from townsquare.llm.common import packed, unpacked

SCALE, SHIFT = 1024, 100_000  # of the whole numbers
LARGEST = float(1 << 52)  # of an entry, so that its whole number is a long
DIMENSIONS_AT_MOST = 4096  # dimensions x dimensions numbers are held on the driver
SWEEPS_AT_MOST = 60
ROWS = 4096  # vectors that a task holds as an array


class Whitening(NamedTuple):
    """What is fitted: the number of vectors, sums of the dimensions, components as columns, and their eigenvalues."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def usable(vector: Column) -> Column:
    """Whether a vector has entries and all of them are finite numbers."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda v: F.coalesce(F.abs(v.cast("double")) < LARGEST, F.lit(False))), F.lit(False))


def whole(vectors: np.ndarray) -> np.ndarray:
    """The whole numbers that stand for entries."""
    return np.floor(SCALE * vectors.astype(np.float64)).astype(np.int64) + SHIFT


def _blocks(column: pa.ChunkedArray | pa.Array, width: int) -> Iterator[np.ndarray]:
    for low in range(0, len(column), ROWS):
        part = column.slice(low, ROWS)
        yield whole(part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), width))


def _exact(x: np.ndarray, terms: int) -> np.ndarray:
    """``x``, as Python's unbounded integers if sums of so many products could leave 64 bits."""
    largest = max(abs(int(x.min())), abs(int(x.max())), 1) if x.size else 1
    return x.astype(object) if largest * largest * max(terms, 1) >= 1 << 62 else x


def _summed(rows: DataFrame, width: int, measure) -> dict[int, list[int]]:
    """Sums over all vectors of the integers that ``measure`` makes of a block of them, a list for each place.

    Each task adds up its own; the lists of the tasks are added by place, in two
    parts so that no sum leaves a decimal's digits.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in _blocks(batch.column(0), width):
                found = measure(block).astype(object)
                total = found if total is None else total + found
        if total is not None:
            for place, line in enumerate(total):
                split = [divmod(int(v), 1 << 64) for v in line]
                high, low = (pa.array([Decimal(x) for x in part], pa.decimal128(28, 0)) for part in zip(*split, strict=True))
                at = [pa.array([place] * len(line), pa.int32()), pa.array(range(len(line)), pa.int32())]
                yield pa.RecordBatch.from_arrays([*at, high, low], ["i", "j", "high", "low"])

    parts = rows.mapInArrow(add, "i int, j int, high decimal(28,0), low decimal(28,0)")
    summed = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    out: dict[int, list[int]] = {}
    for r in summed.orderBy("i", "j").collect():  # width x width at most
        out.setdefault(r["i"], []).append((int(r["high"]) << 64) + int(r["low"]))
    return out


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """``factor`` with ``factor @ factor.T`` equal to a positive semidefinite matrix.

    The largest remaining diagonal entry is the next pivot. The factor is lower
    triangular but for the order of its rows, and has as many columns as the
    matrix has ranks.
    """
    size = len(matrix)
    left, factor = np.diag(matrix).copy(), np.zeros((size, size), matrix.dtype)
    least = left.max(initial=0.0) * size * np.finfo(float).eps
    free = np.ones(size, bool)
    for k in range(size):
        pivot = int(np.argmax(np.where(free, left, -np.inf)))
        if left[pivot] <= least:
            return factor[:, :k]
        free[pivot] = False
        root = np.sqrt(left[pivot])
        factor[pivot, k] = root
        factor[free, k] = (matrix[free, pivot] - factor[free, :k] @ factor[pivot, :k]) / root
        left[free] -= factor[free, k] ** 2
    return factor


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of ``factor @ factor.T`` in falling order, and unit eigenvectors as columns.

    Pairs of columns are rotated until all are orthogonal to double precision;
    in each step, every column is in one pair, so that a step is one product.
    """
    columns = factor.astype(float).copy()
    n = columns.shape[1]
    ring = list(range(n + n % 2))
    for _ in range(SWEEPS_AT_MOST):
        largest = 0.0
        for _ in range(len(ring) - 1):
            pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], reversed(ring[len(ring) // 2 :]), strict=True) if max(a, b) < n]
            p, q = np.array(pairs, int).reshape(-1, 2).T
            left, right = columns[:, p], columns[:, q]
            alpha, beta, gamma = (left * left).sum(0), (right * right).sum(0), (left * right).sum(0)
            size = np.sqrt(alpha * beta)
            off = np.where(size > 0, np.abs(gamma) / np.where(size > 0, size, 1), 0)
            largest = max(largest, off.max(initial=0))
            turn = off > 1e-16
            zeta = np.where(turn, (beta - alpha) / np.where(turn, 2 * gamma, 1), 0)
            tangent = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = np.where(turn, 1 / np.hypot(1, tangent), 1)
            s = np.where(turn, c * tangent, 0)
            columns[:, p], columns[:, q] = c * left - s * right, s * left + c * right
            ring = [ring[0], ring[-1], *ring[1:-1]]
        if largest < 4 * np.finfo(float).eps * max(1, np.sqrt(len(columns))):
            break
    norms = np.sqrt((columns * columns).sum(0))
    order = np.argsort(-norms, kind="stable")
    columns, norms = columns[:, order], norms[order]
    unit = columns / norms
    unit *= np.where(unit[np.abs(unit).argmax(axis=0), np.arange(n)] < 0, -1, 1)  # the largest entry is positive
    return norms**2, unit


def width_of(rows: DataFrame) -> int:
    """The length that most vectors have, the smaller one of equals; 0 without vectors."""
    sizes = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max_by("width", F.struct("n", -F.col("width")))).first()[0]
    return most or 0


def fit(vectors: DataFrame, column: str = "embedding", components: int = 8) -> Whitening:
    """Fits on all usable vectors of the length that most of them have."""
    rows = vectors.select(F.col(column).alias("v")).where(usable(F.col("v"))).select(F.col("v").cast("array<double>").alias("v"))
    width = width_of(rows)
    if not width:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    if width > DIMENSIONS_AT_MOST:
        raise ValueError(f"{width} dimensions are too many for the driver")
    rows = rows.where(F.size("v") == width)
    first = _summed(rows, width, lambda x: np.append(_exact(x, len(x)).sum(axis=0), len(x))[None, :])[0]
    sums, n = first[:-1], first[-1]
    near = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)  # the means, rounded

    def scatter(x: np.ndarray) -> np.ndarray:
        y = _exact(x - near, len(x))
        return y.T @ y

    lines = _summed(rows, width, scatter)
    rest = [s - n * int(m) for s, m in zip(sums, near, strict=True)]
    # n * scatter - rest * rest is n squared times the covariance, in unbounded integers.
    exact = [[n * v - a * b for v, b in zip(lines[i], rest, strict=True)] for i, a in enumerate(rest)]
    # Rounded to long doubles, so that small eigenvalues keep their digits.
    matrix = np.array([[np.longdouble(str(v)) for v in line] for line in exact], np.longdouble) / np.longdouble(str(n * n))
    values, unit = one_sided_jacobi(pivoted_cholesky(matrix).astype(float))
    return Whitening(n, sums, unit[:, :components], values[:components], float(np.trace(matrix)))


def project(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened coordinates of vectors of whole numbers."""
    near = np.array([(2 * s + model.n) // (2 * model.n) for s in model.sums], np.int64)
    rest = np.array([(s - model.n * int(m)) / model.n for s, m in zip(model.sums, near, strict=True)])
    return ((x - near).astype(np.float64) - rest) @ model.vectors / np.sqrt(model.values)


def deviations(x: np.ndarray, model: Whitening) -> list[int]:
    """Exact squared distances of n times the vectors from the sums."""
    far = max(model.n * max(abs(int(x.min())), abs(int(x.max()))), max(map(abs, model.sums))) * 2
    if far * far * x.shape[1] < 1 << 63:
        y = model.n * x - np.array(model.sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    return [int(v) for v in ((model.n * x.astype(object) - np.array(model.sums, object)) ** 2).sum(axis=1)]


def identity_error(vectors: DataFrame, column: str, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the projections minus the identity; 0 without components."""
    size = len(model.values)
    if not size:
        return 0.0
    width = len(model.sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size))
        for batch in batches:
            for block in _blocks(batch.column(0), width):
                z = project(block, model)
                total += np.vstack([z.T @ z, z.sum(axis=0)])
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    rows = vectors.select(F.col(column).alias("v")).where(usable(F.col("v")) & (F.size("v") == width))
    parts = rows.select(F.col("v").cast("array<double>").alias("v")).mapInArrow(add, "i int, j int, v double")
    total = np.zeros((size + 1, size))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["i"], r["j"]] = r["v"]
    mean = total[size] / model.n  # nothing but rounding
    return float(np.abs(total[:size] / model.n - np.outer(mean, mean) - np.eye(size)).max())


def whiten(vectors: DataFrame, column: str = "embedding", components: int = 8, model: Whitening | None = None) -> DataFrame:
    """The rows with a usable vector, all their columns, and ``whitened``, its coordinates, ``deviation``, its exact
    squared distance from the mean in units of 1 / (SCALE * n).

    Vectors that are null or empty, or hold a null or non-finite entry (or one
    beyond 2 ** 52 in size), are left out, and so are those of another length
    than most. Repeated rows count as often as they stand there; nothing is read
    of the other columns, and one named as a result is replaced by it. No rows, no
    result. There are as many coordinates as the vectors span dimensions, and
    ``components`` at most: none where all vectors are equal. ``deviation`` is written
    in digits, since it may be beyond any number type.
    """
    model = fit(vectors, column, components) if model is None else model
    width, size = len(model.sums), len(model.values)

    @F.pandas_udf("whitened array<double>, deviation string")
    def measure(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"whitened": [], "deviation": []})
        x = whole(np.stack(v.to_list()))
        far = list(map(str, deviations(x, model)))
        return pd.DataFrame({"whitened": list(project(x, model)) if size else [[]] * len(x), "deviation": far})

    rows = packed(vectors).where(usable(F.col(f"row.`{column}`")) & (F.size(f"row.`{column}`") == width))
    measured = rows.withColumn("found", measure(F.col(f"row.`{column}`").cast("array<double>")))
    return unpacked(measured, whitened=F.col("found.whitened"), deviation=F.col("found.deviation"))


def whitening_digest(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding", components: int = 8) -> DataFrame:
    """A row for each vector and component: ``vec_id``, ``component`` from 1, ``n``, ``deviation``, ``whitened``,
    ``explained`` (the component's share of the variance) and ``identity_error``.

    ``deviation`` is null where it does not fit into a long; ``deviation_digits`` has it then.
    Otherwise as :func:`whiten`; ids may be null or repeated.
    """
    own = vectors.select(F.col(vec_id).alias("vec_id"), F.col(column).alias("v"))
    model = fit(own, "v", components)
    error = identity_error(own, "v", model)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    rows = whiten(own, "v", components, model).select("vec_id", "deviation", F.posexplode(F.arrays_zip("whitened", shares.alias("share"))).alias("at", "c"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"),
        F.col("deviation").try_cast("bigint").alias("deviation"), F.col("c.whitened").alias("whitened"),
        F.col("c.share").alias("explained"), F.lit(error).alias("identity_error"), F.col("deviation").alias("deviation_digits"),
    )
