"""Embedding whitening: distributed centred covariance, leading components, projection.

Entries become integers on a grid (64 steps a unit, shifted by a million), so sums and deviations are
exact. The model is fitted on the distinct vectors: counts and sums first, then the covariance of the
centred vectors, each task adding up what it reads and Spark adding the tasks' sums by cell. Only
figures whose number depends on the dimension alone reach the driver, where `symmetric` finds the
leading eigenvalues (Householder, Sturm counts) and vectors (inverse iteration). Rows are then
projected where they lie.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped; vectors of
another length than the commonest (the longer of two equally common) and empty vectors give no rows;
entries beyond 2**40 grid steps count as 2**40; repeated rows get equal results; components whose
eigenvalue is zero to rounding are left out, so a single distinct vector, or none, gives no rows; a
deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm import symmetric
from portolan.llm.common import written

GRID, SHIFT, FURTHEST = 64, 1_000_000, 2.0 ** 40
COMPONENTS = 16
#: Vectors that one numpy step holds.
STEP_ROWS = 4096


@dataclass
class Model:
    n: int
    sums: list[int]         # by dimension, exact
    components: np.ndarray  # (dimension, components), unit columns
    values: np.ndarray      # eigenvalues, falling
    explained: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def grid(embedding: Column) -> Column:
    """Integer coordinates of a vector."""
    far = F.lit(FURTHEST)
    return F.transform(embedding.cast("array<double>"), lambda c: F.floor(F.greatest(F.least(c * GRID, far), -far)).cast("long") + SHIFT)


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that count."""
    bad = F.exists(F.col("embedding").cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~bad).select("vec_id", grid(F.col("embedding")).alias("x"))


def _steps(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Matrices of a column of vectors of one length."""
    for lo in range(0, len(column), STEP_ROWS):
        part = column.slice(lo, STEP_ROWS)
        yield np.asarray(part.flatten()).reshape(len(part), -1)


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            for x in _steps(batch.column(0)):
                part = x.sum(axis=0).astype(object)  # 4096 times 2**40 at most: exact; the total is a Python integer
                n, total = n + len(x), part if total is None else total + part
        if n:
            cells = [n, *total]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(cells)), pa.int32()), pa.array([str(int(c)) for c in cells])], names=["at", "sum"])

    rows = vectors.mapInArrow(work, "at int, sum string").groupBy("at").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()
    found = {r["at"]: int(r["sum"]) for r in rows}
    return found.get(0, 0), [found[k] for k in range(1, len(found))]


def _products(vectors: DataFrame, size: int, place: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all vectors of y y^T, where y is place(x): one row of cells per task, added up by Spark."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for x in _steps(batch.column(0)):
                y = place(x)
                total += y.T @ y
        rows, columns = np.triu_indices(size)
        yield pa.RecordBatch.from_arrays([pa.array((rows * size + columns).astype(np.int64)), pa.array(total[rows, columns])], names=["cell", "sum"])

    cells = vectors.mapInArrow(work, "cell long, sum double").groupBy("cell").agg(F.sum("sum").alias("sum")).collect()
    out = np.zeros(size * size)
    for cell, total in cells:
        out[cell] = total
    upper = out.reshape(size, size)
    return upper + np.triu(upper, 1).T


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Model, float] | None:
    """The model of distinct vectors x, and the largest error of the whitened covariance; None without vectors."""
    n, sums = _sums(vectors)
    if not n:
        return None
    mean, size = np.array([s / n for s in sums]), len(sums)
    covariance = _products(vectors, size, lambda x: x - mean) / n
    values, axes = symmetric.leading(covariance, components)
    trace = float(np.trace(covariance))
    real = values > size * symmetric.EPS * max(trace, 0.0)
    values, axes = values[real], axes[:, real]
    model = Model(n, sums, axes, values, values / trace if trace else values)
    if not len(values):
        return model, 0.0
    scaled = axes / np.sqrt(values)
    # A last coordinate of 1 gives the mean of what is whitened, which is taken out of the products.
    again = _products(vectors, len(values) + 1, lambda x: np.column_stack([(x - mean) @ scaled, np.ones(len(x))])) / n
    centred = again[:-1, :-1] - np.outer(again[:-1, -1], again[:-1, -1])
    return model, float(np.abs(centred - np.eye(len(values))).max())


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - sum)**2, exact."""
    reach = max(abs(n * int(edge) - s) for edges in (x.min(axis=0), x.max(axis=0)) for edge, s in zip(edges, sums))
    if len(sums) * reach ** 2 < 1 << 63 and n * int(np.abs(x).max()) < 1 << 63 and max(map(abs, sums)) < 1 << 63:
        far = n * x - np.array(sums, np.int64)
        return (far * far).sum(axis=1).tolist()
    whole = n * x.astype(object) - np.array(sums, object)
    return [v if v < 1 << 63 else None for v in (whole * whole).sum(axis=1).tolist()]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def project(rows: DataFrame, model: Model, error: float) -> DataFrame:
    """Every row (vec_id, x) by every component."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        k, scaled = len(known.values), known.components / np.sqrt(known.values)
        for batch in batches:
            at = 0
            for x in _steps(batch.column(1)):
                count = len(x)
                ids = batch.column(0).slice(at, count)
                at += count
                each = np.repeat(np.arange(count), k)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), pa.array(np.full(count * k, known.n)),
                    pa.array(deviations(x, known.n, known.sums), pa.int64()).take(pa.array(each)), pa.array(((x - known.mean) @ scaled).ravel()),
                    pa.array(np.tile(known.explained, count)), pa.array(np.full(count * k, error))], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(work, SCHEMA)


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened components of all usable rows (vec_id, embedding); the model is fitted on the distinct vectors."""
    spark = rows.sparkSession
    found = usable(rows)
    length = found.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if length is None:
        return spark.createDataFrame([], SCHEMA)
    same = found.select(F.col("vec_id").cast("long"), "x").where(F.size("x") == length["length"])
    # Equal vectors are dropped before the shuffle as well as after it, so a hot vector costs one row a task.
    distinct = written(same.select("x").distinct(), "distinct-vectors")
    model, error = fit(distinct, components)
    if not len(model.values):
        return spark.createDataFrame([], SCHEMA)
    return project(same, model, error)
