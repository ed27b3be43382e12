"""Whitening of embeddings by the leading eigenvectors of their covariance.

Vectors are put on a grid of integers, so their sums are exact. Each task adds up its vectors, then the products of what
is left of them after the mean is taken off; only these sums are shuffled, by rows of the covariance. The covariance, whose
size depends on the dimension alone, is reduced to a tridiagonal matrix by Householder reflections; Sturm counts bisect
its leading eigenvalues; inverse iteration gives their vectors, those of eigenvalues that lie close together made
orthogonal again in each step. The projection is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries beyond this, in absolute value, count as not finite; dimensions of a covariance that the driver takes at most.
LARGEST, MOST_DIMENSIONS = 2.0**30, 4096
#: Share of the largest eigenvalue below which one counts as zero, and share of the norm within which eigenvalues cluster.
NOTHING, CLUSTER = 1e-12, 1e-3


@dataclass
class Whitening:
    """``n`` fitted vectors, their exact sums, and for each component its unit vector, eigenvalue and share of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float


# --- eigenvectors ---


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, side diagonal and reflections that bring a symmetric matrix to tridiagonal form."""
    a, reflections = a.copy(), []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        length = np.sqrt(v @ v)
        v[0] += length if v[0] >= 0 else -length
        size = np.sqrt(v @ v)
        if not size:
            reflections.append(v)
            continue
        v /= size
        rest = a[k + 1 :, k + 1 :]
        p = 2 * (rest @ v)
        p -= (p @ v) * v
        rest -= np.outer(v, p) + np.outer(p, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def sturm_counts(diagonal: np.ndarray, side: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix lie below each number: negative pivots of its elimination."""
    tiny = np.finfo(float).tiny ** 0.5
    pivot = diagonal[0] - at
    below = (pivot < 0).astype(np.int64)
    for d, s in zip(diagonal[1:], side * side):
        pivot = d - at - s / np.where(np.abs(pivot) < tiny, -tiny, pivot)
        below += pivot < 0
    return below


def leading_values(diagonal: np.ndarray, side: np.ndarray, most: int) -> np.ndarray:
    """The largest eigenvalues, falling, by bisection of the circles that hold all."""
    n = len(diagonal)
    reach = np.abs(np.append(side, 0)) + np.abs(np.append(0, side))
    low, high = np.full(most, (diagonal - reach).min()), np.full(most, (diagonal + reach).max())
    rank = n - np.arange(1, most + 1)  # so many lie below the one sought
    slack = 4 * np.finfo(float).eps * max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    low, high = low - slack, high + slack
    while True:
        middle = (low + high) / 2
        if ((high - low <= slack / 8) | (middle <= low) | (middle >= high)).all():
            return middle
        above = sturm_counts(diagonal, side, middle) <= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)


def _solved(diagonal: np.ndarray, side: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """Solve the shifted tridiagonal system by elimination with row exchanges; a pivot of zero is replaced by a tiny one."""
    n = len(diagonal)
    tiny = np.finfo(float).eps * max(np.abs(diagonal).max(), np.finfo(float).tiny)
    whole, under = (diagonal - shift).tolist(), side.tolist() + [0.0]
    pivot, over, value, rows = whole[0], under[0], float(right[0]), []
    for i in range(n - 1):
        below, next_pivot, next_over, next_value = under[i], whole[i + 1], under[i + 1], float(right[i + 1])
        if abs(below) > abs(pivot):
            rows.append((below, next_pivot, next_over, next_value))
            factor = pivot / below
            pivot, over, value = over - factor * next_pivot, -factor * next_over, value - factor * next_value
        else:
            pivot = pivot or tiny
            rows.append((pivot, over, 0.0, value))
            factor = below / pivot
            pivot, over, value = next_pivot - factor * over, next_over, next_value - factor * value
    rows.append((pivot or tiny, 0.0, 0.0, value))
    out = [0.0] * (n + 2)
    for i in range(n - 1, -1, -1):
        pivot, over, far, value = rows[i]
        out[i] = (value - over * out[i + 1] - far * out[i + 2]) / pivot
    return np.array(out[:n])


def leading_vectors(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns. The entry of the
    largest size of each is positive."""
    diagonal, side, reflections = tridiagonal(a)
    values = leading_values(diagonal, side, most)
    norm = max(np.abs(diagonal).max(), np.abs(side).max(initial=0))
    vectors, random, begin = np.zeros((len(a), most)), np.random.default_rng(11), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            begin = j
        shift = value - 10 * np.finfo(float).eps * norm * (j - begin)  # equal eigenvalues get shifts of their own
        x = random.standard_normal(len(a))
        for _ in range(5):
            scale = np.abs(x).max()
            x = _solved(diagonal, side, shift, x / scale if scale else x)
            x /= np.abs(x).max() or 1.0
            for _ in range(2):
                for k in range(begin, j):
                    x -= (vectors[:, k] @ x) * vectors[:, k]
            x /= np.sqrt(x @ x) or 1.0
        vectors[:, j] = x
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        vectors[k + 1 :] -= 2 * np.outer(v, v @ vectors[k + 1 :])
    vectors /= np.sqrt((vectors * vectors).sum(axis=0))
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(most)]
    return values, vectors * np.where(largest < 0, -1.0, 1.0)


# --- sums over the cluster ---


def usable(vector: str) -> Column:
    """Vectors that aren't null and hold finite entries only."""
    return F.expr(f"`{vector}` is not null and size(`{vector}`) > 0 and forall(`{vector}`, c -> c is not null and abs(c) <= {LARGEST!r}D)")


def _on_grid(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of integers."""
    if not len(column):
        return np.zeros((0, 1), np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.floor(flat * SCALE).astype(np.int64) + SHIFT


class _Centred:
    """Vectors without their mean; the mean's whole part is taken off exactly."""

    def __init__(self, n: int, sums: list[int]):
        self.whole = np.array([s // n for s in sums], np.int64)
        self.part = np.array([(s % n) / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.part


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = _on_grid(batch.column(0))
            n += len(x)
            if len(x):
                total = x.sum(axis=0).astype(object) if total is None else total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array([n] * len(total), pa.int64()), pa.array([Decimal(int(s)) for s in total], pa.decimal128(38, 0))],
                ["place", "n", "s"],
            )

    found = rows.mapInArrow(run, "place int, n long, s decimal(38,0)").groupBy("place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("place").collect()
    return (found[0]["n"], [int(r["s"]) for r in found]) if found else (0, [])


def _covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance, by rows of each task's products, which are added up row by row where they meet."""
    size, centred = len(sums), _Centred(n, sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            if len(batch):
                z = centred(_on_grid(batch.column(0)))
                total += z.T @ z
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(size, dtype=np.int32)), pa.array([task] * size, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(0, size * size + 1, size, dtype=np.int32)), pa.array(total.ravel()))],
            ["place", "task", "products"],
        )

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, values in zip(batch.column("place").to_pylist(), batch.column("products")):
                row = values.values.to_numpy(zero_copy_only=False)
                total[place] = total[place] + row if place in total else row
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([list(v) for v in total.values()], pa.list_(pa.float64()))], ["place", "products"])

    schema = "place int, task int, products array<double>"
    met = rows.mapInArrow(products, schema).repartition("place").sortWithinPartitions("place", "task").select("place", "products")
    found = met.mapInArrow(added, "place int, products array<double>").orderBy("place").collect()
    total = np.array([r["products"] for r in found])
    return (total + total.T) / 2 / n


def fit(df: DataFrame, components: int = 8, vector: str = "embedding") -> Whitening | None:
    """The whitening of a table's usable vectors; None where there are none, or where they are all equal.

    Vectors take part that have the length most of them have (of equally frequent lengths the shorter). Components whose
    eigenvalue is nothing beside the largest are left out, so there may be fewer than asked for.
    """
    lengths = df.where(usable(vector)).groupBy(F.size(vector).alias("length")).count().orderBy(F.desc("count"), "length").first()
    if lengths is None:
        return None
    size = lengths["length"]
    if size > MOST_DIMENSIONS:
        raise ValueError(f"{size} dimensions; the covariance of {MOST_DIMENSIONS} at most is reduced on the driver")
    rows = df.where(usable(vector) & (F.size(vector) == size)).select(vector)
    n, sums = _sums(rows)
    covariance = _covariance(rows, n, sums)
    trace = float(np.trace(covariance))
    if not trace > 0:
        return None
    values, vectors = leading_vectors(covariance, min(components, size)) if size > 1 else (covariance[0], np.ones((1, 1)))
    some = values > NOTHING * values[0]
    model = Whitening(n, sums, vectors[:, some], values[some], values[some] / trace, 0.0)
    model.identity_error = _identity_error(rows, model)
    return model


def _whitened(model: Whitening, centred: _Centred, x: np.ndarray) -> np.ndarray:
    return centred(x) @ (model.vectors / np.sqrt(model.values))


def _identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance less the identity."""
    centred, m = _Centred(model.n, model.sums), len(model.values)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(m), np.zeros((m, m))
        for batch in batches:
            if len(batch):
                w = _whitened(shared.value, centred, _on_grid(batch.column(0)))
                first += w.sum(axis=0)
                second += w.T @ w
        values = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["place", "s"])

    found = rows.mapInArrow(run, "place int, s double").groupBy("place").agg(F.sum("s").alias("s")).orderBy("place").collect()
    values = np.array([r["s"] for r in found]) / model.n
    return float(np.abs(values[m:].reshape(m, m) - np.outer(values[:m], values[:m]) - np.eye(m)).max())


def whiten(df: DataFrame, model: Whitening | None, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """``(row_id, whitened, deviation)`` of every vector of the fitted length: its coordinates along the components, each with
    variance one, and the sum over all dimensions of (n * x - S)^2, exact (decimal; null beyond 38 digits).

    Vectors that are null, empty, of another length, or hold null or non-finite entries are left out; so are all where there
    is no model. A null id is kept; repeated rows get equal results; other columns aren't read.
    """
    schema = f"{row_id} {df.schema[row_id].dataType.simpleString()}, whitened array<double>, deviation decimal(38,0)"
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    size, centred = len(model.sums), _Centred(model.n, model.sums)
    remainders = np.array([s - model.n * int(w) for s, w in zip(model.sums, centred.whole)], np.int64)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def deviations(x: np.ndarray) -> pa.Array:
        moved = x - centred.whole
        reach = (float(np.abs(moved).max(initial=0)) + 1) * model.n
        if reach < 2**62 and reach * reach * size < 2**62:
            return pa.array(((moved * model.n - remainders) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
        exact = ((moved.astype(object) * model.n - remainders.astype(object)) ** 2).sum(axis=1)
        return pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _on_grid(batch.column(1))
                w = _whitened(shared.value, centred, x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, deviations(x)], [row_id, "whitened", "deviation"])

    rows = df.where(usable(vector) & (F.size(vector) == size)).select(row_id, vector)
    return rows.mapInArrow(run, schema)
