"""Whitening of embeddings by a covariance in two passes.

Entries are fixed to whole numbers, so that the first pass adds exact integers;
the second centres every vector of the fit list by these sums before it multiplies
(one NumPy matrix product a batch).  Partial results of d or d x d numbers a task
are merged by ``treeAggregate``, deep enough that the driver gets few of them;
the eigenvectors of the symmetric covariance come from LAPACK on the driver, and
the projection of d x 16 numbers is broadcast.  A third pass over the fit list
measures how far the covariance of the whitened vectors is from the identity.

The fit list is each different vector once, by a distinct on the whole vectors
with partial aggregation, so a hot group of copies adds one row a task.

Defined cases: a vector that is null, empty, or holds null or non-finite entries
is dropped; so is one that has not the dimension most vectors have (of equally
frequent ones the largest); entries beyond 2**62 are cut to it; repeated rows,
null ids and rows of one id each give their own rows; a component whose
eigenvalue is zero to double precision has ``whitened`` null; ``deviation`` is
null where it exceeds a long; an empty table gives an empty one; other columns
are of no account, and ids may have any type and name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locuspark.plans.naming import col, fresh
from locuspark.plans.scratch import materialize

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
_MOST = float(1 << 62)
_LOW = (1 << 20) - 1


def finite(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite."""
    return (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def fixed(vector: Column) -> Column:
    """The entries of a finite vector as whole numbers."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(_MOST)), F.lit(-_MOST))) + F.lit(SHIFT).cast("long"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    x = batch.column(batch.schema.get_field_index("x"))
    flat = x.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(x), -1) if len(x) else np.zeros((0, 0), np.int64)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of vectors and exact sums of one task."""
    n, total = 0, None
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch)
            part = [(h << 20) + lo for h, lo in zip((x >> 20).sum(axis=0).tolist(), (x & _LOW).sum(axis=0).tolist(), strict=True)]
            total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
            n += len(x)
    if n:
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "sums": pa.array([[str(t) for t in total]], pa.list_(pa.string()))})


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact; of Python integers where 64 bits could be too few."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if n * most < 1 << 61 and max(map(abs, sums), default=0) < 1 << 61:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _squares(dev: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row, null beyond a long."""
    if dev.dtype != object and (not dev.size or int(np.abs(dev).max()) <= math.isqrt(((1 << 63) - 1) // dev.shape[1])):
        return (dev * dev).sum(axis=1).tolist()
    found = [sum(v * v for v in row) for row in dev.tolist()]
    return [f if f < 1 << 63 else None for f in found]


def _products(n: int, sums: list[int], projection: np.ndarray | None):
    """Sums and products, as bytes of doubles, of one task's centred vectors, projected if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = first = None
        for batch in batches:
            if batch.num_rows:
                z = _deviations(_matrix(batch), n, sums).astype(np.float64) / n
                if projection is not None:
                    z = z @ projection
                total, first = (z.T @ z, z.sum(axis=0)) if total is None else (total + z.T @ z, first + z.sum(axis=0))
        if total is not None:
            yield pa.RecordBatch.from_pydict({"first": pa.array([first.tobytes()], pa.binary()), "second": pa.array([total.tobytes()], pa.binary())})

    return run


def _tree(parts: DataFrame, zero, add):
    """Rows merged by a tree in which each task, and the driver, gets about sixteen partial results."""
    rdd = parts.rdd
    return rdd.treeAggregate(zero, lambda t, r: add(t, tuple(r)), add, max(2, math.ceil(math.log(max(rdd.getNumPartitions(), 2), 16))))


def _fit_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    def add(a, b):
        return a[0] + b[0], [int(x) + int(y) for x, y in zip(a[1], b[1], strict=True)]

    return _tree(fit.mapInArrow(_sums, "n long, sums array<string>"), (0, [0] * d), add)


def _moments(fit: DataFrame, n: int, sums: list[int], projection: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (divisor n) of the centred vectors, projected if asked for."""
    d = len(sums) if projection is None else projection.shape[1]
    zero = (np.zeros(d).tobytes(), np.zeros(d * d).tobytes())

    def add(a, b):
        return tuple((np.frombuffer(x) + np.frombuffer(y)).tobytes() for x, y in zip(a, b, strict=True))

    first, second = _tree(fit.mapInArrow(_products(n, sums, projection), "first binary, second binary"), zero, add)
    mean = np.frombuffer(first) / n
    return mean, np.frombuffer(second).reshape(d, d) / n - (0 if projection is None else np.outer(mean, mean))


def components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues, falling, their unit eigenvectors as columns, and how many are above zero."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    least = max(values[0], 0.0) * len(covariance) * 8 * np.finfo(float).eps
    return np.maximum(values, 0.0), vectors, int((values > least).sum())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """For each vector that stays and each of the first k components a row.

    Columns: the id, component (from 1), n (vectors of the fit list), deviation,
    whitened, explained and identity_error.
    """
    spark = rows.sparkSession
    names = fresh([id_col], "component", "n", "deviation", "whitened", "explained", "identity_error")
    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), *[T.StructField(c, t()) for c, t in zip(names, (T.IntegerType, T.LongType, T.LongType, T.DoubleType, T.DoubleType, T.DoubleType), strict=True)]])
    found = rows.select(col(id_col).alias("id"), col(vector_col).alias("v")).filter(finite(F.col("v")))
    size = found.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if size is None:
        return spark.createDataFrame([], schema)
    usable = found.filter(F.size("v") == size["d"]).select("id", fixed(F.col("v")).alias("x"))
    fit = materialize(usable.select("x").distinct())
    n, sums = _fit_sums(fit, size["d"])
    _, covariance = _moments(fit, n, sums, None)
    values, vectors, rank = components(covariance, k)
    trace = float(np.trace(covariance))
    explained = values / trace if trace > 0 else np.zeros(len(values))
    projection = vectors[:, :rank] / np.sqrt(values[:rank])
    error = float(np.abs(_moments(fit, n, sums, projection)[1] - np.eye(rank)).max()) if rank else None
    model = spark.sparkContext.broadcast((n, sums, projection, explained, error))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, projection, explained, error = model.value
        kind, c = None, len(explained)
        for batch in batches:
            if not batch.num_rows:
                continue
            dev = _deviations(_matrix(batch), n, sums)
            out = np.full((len(dev), c), np.nan)
            out[:, : projection.shape[1]] = (dev.astype(np.float64) / n) @ projection
            each = np.repeat(np.arange(len(dev)), c)
            ids = batch.column(0)
            kind = pa.schema([pa.field("id", ids.type), *[pa.field(a, b) for a, b in zip(names, (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)]])
            white = pa.array(out.ravel(), mask=np.tile(np.arange(c) >= projection.shape[1], len(dev)))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(dev))), pa.array(np.full(len(each), n, np.int64)), pa.array(_squares(dev), pa.int64()).take(pa.array(each)),
                 white, pa.array(np.tile(explained, len(dev))), pa.array([error] * len(each), pa.float64())],
                schema=kind.set(0, pa.field(id_col, ids.type)),
            )

    return usable.mapInArrow(project, schema)
