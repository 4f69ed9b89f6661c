"""Whitening of embeddings from exact variances.

Entries become whole numbers first, so every sum is exact whatever its order. One pass counts the
vectors and sums each dimension. A second one centres the entries on the nearest whole mean and
sums the squares of every dimension and of the sum of every two dimensions; what the whole mean
leaves over is taken off in unbounded integers. By polarisation a covariance is half of the
variance of the sum less both variances, so the squares give the whole matrix, which is divided
and rounded once and handed to eigh. Tasks send one row per dimension, with its sums of squares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseframe.llm.shared import ship

#: Whole numbers of a unit, and the number that stands for zero.
SCALE, ZERO = 64, 1_000_000
COMPONENTS = 32
#: Entries from here on are no 64-bit whole number.
LARGEST = 2.0**60 / SCALE
#: Share of the total variance below which a component is taken for rounding.
LEAST_SHARE = 1e-13
#: Rows whose squares are summed at once.
BLOCK = 4096

SUMS = "dimension int, total decimal(38,0), vectors bigint"
SQUARES = "dimension int, squares array<decimal(38,0)>"
WHITE = "vec_id bigint, deviation decimal(38,0), whitened array<double>"


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: all that projecting a vector needs."""

    count: int
    sums: tuple[int, ...]
    #: Eigenvalues that are above rounding, falling, and their unit vectors as columns.
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def middle(self) -> np.ndarray:
        """The whole number nearest to the mean of each dimension."""
        return np.array([(2 * s + self.count) // (2 * self.count) for s in self.sums], np.int64)


def usable(embeddings: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has entries, all of them finite and within 64 bits as whole numbers."""
    fits = F.forall(column, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    return embeddings.filter(F.col(column).isNotNull() & (F.size(column) > 0) & fits)


def _whole(batch: pa.RecordBatch) -> np.ndarray:
    """floor(SCALE * entry) + ZERO of a batch of equally long vectors, a row each."""
    vectors = batch["vector"]
    lengths = np.diff(vectors.offsets.to_numpy())
    if len(set(lengths.tolist())) > 1:
        raise ValueError(f"vectors of {sorted(set(lengths.tolist()))} dimensions")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(len(lengths), -1) + ZERO


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            yield part, _whole(part)


def _exact(x: np.ndarray, terms: int, power: int = 1) -> np.ndarray:
    """The numbers as they are if sums of so many such powers fit 64 bits, else as Python's."""
    largest = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    return x if terms * largest**power < 2**63 else x.astype(object)


def _decimals(numbers) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in numbers], pa.decimal128(38, 0))


def _sum_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals, count = None, 0
    for _, x in _blocks(batches):
        part = _exact(x, len(x)).sum(0).astype(object)
        if totals is not None and len(part) != len(totals):
            raise ValueError(f"vectors of {len(totals)} and {len(part)} dimensions")
        totals, count = part if totals is None else totals + part, count + len(x)
    if totals is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(totals)), pa.int32()), _decimals(totals),
             pa.array([count] * len(totals), pa.int64())], names=["dimension", "total", "vectors"])


def _sum_squares(middle: np.ndarray):
    """Per dimension i the sums of (z_i + z_j)^2 over j from i on; for j = i that of z_i^2."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for _, x in _blocks(batches):
            z = np.ascontiguousarray(_exact(x - middle, 4 * len(x), 2).T)
            found = []
            for i in range(len(z)):
                pair = z[i:] + z[i]
                pair[0] = z[i]
                found.append((pair * pair).sum(1).astype(object))
            sums = found if sums is None else [a + b for a, b in zip(sums, found)]
        for i, row in enumerate(sums or []):
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), pa.ListArray.from_arrays(
                    pa.array([0, len(row)], pa.int32()), _decimals(row))],
                names=["dimension", "squares"])
    return add


def _covariance(count: int, squares: dict[int, list[int]], rest: list[int]) -> np.ndarray:
    """Polarisation: halves of differences of variances, each rounded once.

    `rest` is by how much the sum of a centred dimension is off zero.
    """
    size = len(rest)
    variance = [count * squares[i][0] - rest[i] ** 2 for i in range(size)]
    matrix = np.empty((size, size))
    for i in range(size):
        matrix[i, i] = Fraction(variance[i], count**2)
        for j in range(i + 1, size):
            both = count * squares[i][j - i] - (rest[i] + rest[j]) ** 2
            matrix[i, j] = matrix[j, i] = Fraction(
                both - variance[i] - variance[j], 2 * count**2)
    return matrix


def fit(embeddings: DataFrame, column: str = "embedding") -> Whitening | None:
    """Whitening of all usable rows; None if there are none.

    The driver gets one number per dimension and pair of dimensions, however many rows there are.
    """
    ship(embeddings.sparkSession)
    rows = usable(embeddings, column).select(F.col(column).alias("vector"))
    totals = (rows.mapInArrow(_sum_entries, SUMS).groupBy("dimension")
              .agg(F.sum("total").alias("total"), F.sum("vectors").alias("vectors"))
              .orderBy("dimension").collect())
    if not totals:
        return None
    if len({row.vectors for row in totals}) > 1:
        raise ValueError(f"vectors of several lengths, of {len(totals)} dimensions at most")
    count, sums = totals[0].vectors, tuple(int(row.total) for row in totals)
    bare = Whitening(count, sums, np.empty(0), np.empty((len(sums), 0)), 0.0)
    added = (rows.mapInArrow(_sum_squares(bare.middle), SQUARES)
             .select("dimension", F.posexplode("squares").alias("place", "squared"))
             .groupBy("dimension", "place").agg(F.sum("squared").alias("squared")))
    squares = {row.dimension: [int(s.squared) for s in row.held] for row in added
               .groupBy("dimension")
               .agg(F.sort_array(F.collect_list(F.struct("place", "squared"))).alias("held"))
               .collect()}
    rest = [s - count * int(m) for s, m in zip(sums, bare.middle)]
    matrix = _covariance(count, squares, rest)
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(matrix.trace())
    held = values > LEAST_SHARE * trace
    vectors = vectors[:, held]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), range(vectors.shape[1])])
    return Whitening(count, sums, values[held], vectors * signs, trace)


def _projector(model: Whitening, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors over the root of their eigenvalues, and what the whole means leave over."""
    rest = np.array([float(Fraction(s, model.count) - int(m))
                     for s, m in zip(model.sums, model.middle)])
    return model.vectors[:, :components] / np.sqrt(model.values[:components]), rest


def whitened(embeddings: DataFrame, model: Whitening, components: int = COMPONENTS,
             column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """vec_id, deviation and the whitened components of every usable row.

    The deviation is the exact sum of (n*x - S)^2 over all dimensions; null beyond 38 digits.
    """
    ship(embeddings.sparkSession)
    matrix, rest = _projector(model, components)
    n, middle = model.count, model.middle
    over = [s - n * int(m) for s, m in zip(model.sums, middle)]
    wide = max(map(abs, over), default=0)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches):
            z = x - middle
            largest = n * max(abs(int(z.min())), abs(int(z.max()))) + wide
            exact = z if len(middle) * largest**2 < 2**63 else z.astype(object)
            deviation = ((n * exact - np.array(over, exact.dtype)) ** 2).sum(1).tolist()
            scores = (z - rest) @ matrix
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"],
                 pa.array([Decimal(d) if d < 10**38 else None for d in deviation],
                          pa.decimal128(38, 0)),
                 pa.ListArray.from_arrays(
                     pa.array(np.arange(len(scores) + 1) * scores.shape[1], pa.int32()),
                     pa.array(scores.ravel()))],
                names=["vec_id", "deviation", "whitened"])

    return usable(embeddings, column).select(
        F.col(key).cast("bigint").alias("vec_id"), F.col(column).alias("vector")).mapInArrow(
        project, WHITE)


def identity_error(white: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of whitened rows minus the identity.

    Rows are taken about the mean of their task; sums of squares about it are put together
    with those of the means, so nothing is squared before it is centred.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, mean, spread = 0, np.zeros(components), np.zeros((components, components))
        for batch in batches:
            scores = batch["whitened"].flatten().to_numpy().reshape(-1, components)
            if not len(scores):
                continue
            own = scores.mean(0)
            gap, total = own - mean, count + len(scores)
            spread += (scores - own).T @ (scores - own)
            spread += np.outer(gap, gap) * (count * len(scores) / total)
            mean, count = mean + gap * (len(scores) / total), total
        if count:
            yield pa.RecordBatch.from_arrays(
                [pa.array([count], pa.int64()), pa.array([mean.tolist()]),
                 pa.array([spread.ravel().tolist()])], names=["count", "mean", "spread"])

    parts = white.select("whitened").mapInArrow(
        add, "count bigint, mean array<double>, spread array<double>")
    places = F.sequence(F.lit(0), F.lit(components**2 - 1))
    left = F.col("mean")[F.floor(F.col("place") / components).cast("int")]
    right = F.col("mean")[F.col("place") % components]
    sums = (parts.select("count", "mean", "spread", F.explode(places).alias("place"))
            .select("place", "count", F.col("spread")[F.col("place")].alias("spread"),
                    left.alias("left"), right.alias("right"))
            .groupBy("place").agg(
                F.sum("count").alias("count"), F.sum("spread").alias("spread"),
                F.sum(F.col("count") * F.col("left") * F.col("right")).alias("between"),
                F.sum(F.col("count") * F.col("left")).alias("left"),
                F.sum(F.col("count") * F.col("right")).alias("right")).collect())
    error = 0.0
    for row in sums:
        centred = row.spread + row.between - row.left * row.right / row["count"]
        on_diagonal = row.place // components == row.place % components
        error = max(error, abs(centred / row["count"] - on_diagonal))
    return error


def whitening(embeddings: DataFrame, components: int = COMPONENTS, column: str = "embedding",
              key: str = "vec_id") -> DataFrame:
    """A row per usable vector and component: deviation, whitened value, share of the variance.

    Vectors that are null, empty or hold a null, a non-finite number or one beyond 64 bits are
    left out; vectors of different lengths are an error. Rows that repeat an id or a vector each
    count; a null id stays null. Components whose eigenvalue is within rounding of zero, as of
    dimensions that never vary, do not exist: a table of equal vectors gives no rows, like an
    empty one. Other columns are ignored.
    """
    model = fit(embeddings, column)
    found = min(components, len(model.values)) if model else 0
    if not found:
        return embeddings.sparkSession.createDataFrame(
            [], "vec_id bigint, component int, n bigint, deviation decimal(38,0), "
                "whitened double, explained double, identity_error double")
    white = whitened(embeddings, model, found, column, key)
    error = identity_error(white, found)
    shares = F.array(*(F.lit(float(v / model.trace)) for v in model.values[:found]))
    return (white.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
            .select("vec_id", (F.col("place") + 1).alias("component"),
                    F.lit(model.count).cast("bigint").alias("n"), "deviation", "whitened",
                    shares[F.col("place")].alias("explained"),
                    F.lit(error).alias("identity_error")))
