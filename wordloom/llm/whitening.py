"""Whiten vectors by pivoted Cholesky and one-sided Jacobi.

The scatter of the centred vectors is summed over partitions, centred before it is multiplied: with
sums S over n vectors, S = q n + r, an entry x becomes (x - q) - r / n, whose first part is exact. What
is left is of the size of the dimension. There the covariance is factored by Cholesky, the
largest remaining pivot first, until nothing but rounding remains, and the columns of the factor
are rotated in pairs until all are orthogonal. Their squared norms are the eigenvalues, the normalised columns the components; the
covariance is never diagonalised itself, so small eigenvalues keep their digits.

Only the sums (d numbers) and the scatter (d x d) come to the driver and go to the workers; they grow with the dimension, not with the rows.

Defined cases: a vector that is null or holds a null, NaN or infinite entry takes no part; repeated vectors count once in the fit and each has its rows;
shorter vectors are filled up with zeros; components exist for eigenvalues above rounding only, so equal vectors, one vector or none give no
rows; a deviation that no long can hold is null; entries beyond a long are the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import bounded_batches, free_name
from wordloom.session import materialize

SWEEPS = 60
OUT = 1 << 14  # rows of a batch that a task hands on
LARGEST = 2**63 - 1
SAFE = 2**52  # sums of a batch of entries below stay within a long


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))


def quantized(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda v: F.floor(v.cast("double") * scale))


# -- on matrices of the size of the dimension ------------------------------------------


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """L with L L' = matrix, a column for each pivot above rounding; rows in the matrix's order."""
    d = len(matrix)
    rest, columns = matrix.diagonal().astype(float).copy(), []
    least = d * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    factor = np.zeros((d, d))
    for k in range(d):
        pivot = int(np.argmax(rest))
        if rest[pivot] <= least:
            break
        column = (matrix[:, pivot] - factor[:, :k] @ factor[pivot, :k]) / np.sqrt(rest[pivot])
        column[columns] = 0.0  # earlier pivots: exactly nothing is left of them
        column[pivot] = np.sqrt(rest[pivot])
        factor[:, k] = column
        columns.append(pivot)
        rest -= column**2
        rest[columns] = -1.0
    return factor[:, : len(columns)]


def jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) of factor factor', falling: columns are rotated, as many disjoint pairs
    at a time as there are, until every pair is orthogonal."""
    g = factor.copy()
    d, r = g.shape
    odd = r % 2
    players = list(range(r)) + ([None] if odd else [])
    tight = np.sqrt(d) * np.finfo(float).eps
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(len(players) - 1):
            pairs = [(a, b) for a, b in zip(players[: len(players) // 2], reversed(players[len(players) // 2 :])) if a is not None and b is not None]
            players = [players[0], players[-1], *players[1:-1]]
            if not pairs:
                continue
            p, q = (np.array(x) for x in zip(*pairs))
            x, y = g[:, p], g[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            angle = np.abs(c) / np.sqrt(a * b)
            worst = max(worst, float(angle.max()))
            turn = angle > tight
            if not turn.any():
                continue
            p, q, x, y = p[turn], q[turn], x[:, turn], y[:, turn]
            zeta = (b[turn] - a[turn]) / (2 * c[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta**2))
            cos = 1 / np.sqrt(1 + t**2)
            g[:, p], g[:, q] = cos * x - cos * t * y, cos * t * x + cos * y
        if worst <= tight:
            break
    norms = np.sqrt((g * g).sum(0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, g[:, order] / norms[order]


# -- over the rows ---------------------------------------------------------------------


@dataclass
class Whitening:
    n: int
    quotient: list[int]  # of the sums by n
    remainder: list[int]
    values: np.ndarray  # eigenvalues, falling
    axes: np.ndarray  # a column per eigenvalue
    trace: float
    identity_error: float = float("nan")

    @property
    def sums(self) -> list[int]:
        return [q * self.n + r for q, r in zip(self.quotient, self.remainder)]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of ``d`` longs; shorter lists end in zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == d).all():
        return flat.astype(np.int64).reshape(len(sizes), d)
    out = np.zeros((len(sizes), d), np.int64)
    ends = np.cumsum(sizes)
    for i, (end, size) in enumerate(zip(ends.tolist(), sizes.tolist())):
        out[i, :size] = flat[end - size : end]
    return out


def _centred(x: np.ndarray, quotient: np.ndarray, remainder: np.ndarray, n: int) -> np.ndarray:
    return (x - quotient).astype(float) - remainder.astype(float) / n


def _totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows of the column ``x`` and exact sums by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, []
        for batch in batches:
            lists = batch.column(0)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            d = int(sizes.max(initial=0))
            x = _matrix(lists, d)
            sums += [0] * (d - len(sums))
            small = not x.size or (-SAFE < x.min() and x.max() < SAFE)
            found = x.sum(0).tolist() if small else x.astype(object).sum(0).tolist()
            sums[:d] = [a + b for a, b in zip(sums, found)]
            n += len(sizes)
        if n:
            counted = [(i, Decimal(s)) for i, s in enumerate(sums)] + [(-1, Decimal(n))]
            yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in counted], pa.int32()), pa.array([c[1] for c in counted], pa.decimal128(38, 0))], names=["i", "s"])

    found = {r.i: int(r.s) for r in rows.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()}
    n = found.pop(-1, 0)
    return n, [found[i] for i in range(len(found))]


def _summed(rows: DataFrame, per_partition, d: int) -> np.ndarray:
    """Sum over partitions of the matrices (of ``d`` rows) that ``per_partition`` makes of the batches; added row by row, in order of partitions."""
    part = F.spark_partition_id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            if batch.num_rows:
                at = batch.column(1)[0].as_py()
                found = per_partition(batch.column(0))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(total)), pa.int32()), pa.array([at] * len(total), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "part", "row"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for i, row in zip(batch.column(0).to_pylist(), batch.column(2)):
                row = row.values.to_numpy()
                if i != now and now is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["i", "row"])
                now, total = i, (row.copy() if i != now else total + row)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["i", "row"])

    partial = rows.select("x", part.alias("part")).mapInArrow(run, "i int, part int, row array<double>")
    whole = partial.repartition("i").sortWithinPartitions("i", "part").mapInArrow(add, "i int, row array<double>").collect()
    found = {r.i: r.row for r in whole}
    return np.array([found[i] for i in range(d)])


def fit(vectors: DataFrame, vector: str, components: int) -> Whitening | None:
    """The whitening of the distinct values of ``vector`` (arrays of longs), None if there are none."""
    bounded_batches(vectors.sparkSession)
    rows = materialize(vectors.select(F.col(vector).alias("x")).distinct(), "distinct-vectors")
    n, sums = _totals(rows)
    if not n:
        return None
    d = len(sums)
    parts = [divmod(s, n) for s in sums]
    quotient, remainder = [p[0] for p in parts], [p[1] for p in parts]
    if not d:
        return Whitening(n, quotient, remainder, np.zeros(0), np.zeros((0, 0)), 0.0)
    q, r = np.array(quotient, np.int64), np.array(remainder, np.int64)

    def scatter(column: pa.Array) -> np.ndarray:
        z = _centred(_matrix(column, d), q, r, n)
        return z.T @ z

    covariance = _summed(rows, scatter, d) / n
    values, axes = jacobi(pivoted_cholesky((covariance + covariance.T) / 2))
    out = Whitening(n, quotient, remainder, values[:components], axes[:, :components], float(np.trace(covariance)))
    k = len(out.values)
    if not k:
        return out
    turn = out.axes / np.sqrt(out.values)

    def moments(column: pa.Array) -> np.ndarray:
        w = _centred(_matrix(column, d), q, r, n) @ turn
        return np.vstack([w.T @ w, w.sum(0)])

    found = _summed(rows, moments, k + 1) / n
    out.identity_error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    return out


def _deviation(x: np.ndarray, w: Whitening) -> list[int | None]:
    """Sum over places of (n x - S) squared; exact, null beyond a long."""
    q, r = np.array(w.quotient, object), np.array(w.remainder, object)
    most = max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0) + max(map(abs, w.quotient), default=0)
    if x.shape[1] * (w.n * (most + 1)) ** 2 <= LARGEST:
        y = w.n * (x - q.astype(np.int64)) - r.astype(np.int64)
        return (y * y).sum(1).tolist()
    out = []
    for row in x:
        y = w.n * (row.astype(object) - q) - r
        total = int((y * y).sum())
        out.append(total if total <= LARGEST else None)
    return out


def whiten(vectors: DataFrame, vector: str, fitted: Whitening | None, keep: list[str]) -> DataFrame:
    """A row for each row of ``vectors`` and component: ``keep``, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    names = free_name(vectors.select(*keep), "component", "n", "deviation", "whitened", "explained", "identity_error")
    kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([*vectors.select(*keep).schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds)]])
    if fitted is None or not len(fitted.values):
        return spark.createDataFrame([], schema)
    shipped = spark.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shipped.value
        d, k = len(w.quotient), len(w.values)
        q, r = np.array(w.quotient, np.int64), np.array(w.remainder, np.int64)
        turn, explained = w.axes / np.sqrt(w.values), w.values / w.trace
        for batch in batches:
            m = batch.num_rows
            x = _matrix(batch.column(len(keep)), d)
            place = pa.array(np.repeat(np.arange(m), k))
            columns = [batch.column(i).take(place) for i in range(len(keep))]
            columns += [
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n, np.int64)),
                pa.array(_deviation(x, w), pa.int64()).take(place), pa.array((_centred(x, q, r, w.n) @ turn).ravel()),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * k, w.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return vectors.select(*keep, vector).mapInArrow(run, schema)


def whiten_embeddings(embeddings: DataFrame, keep: list[str], vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """``whiten`` of the vectors' entries times ``scale``, rounded down, fitted on all of them."""
    (x,) = free_name(embeddings, "x")
    rows = embeddings.filter(usable(F.col(vector))).select(*keep, quantized(F.col(vector), scale).alias(x))
    return whiten(rows, x, fit(rows, x, components), keep)
