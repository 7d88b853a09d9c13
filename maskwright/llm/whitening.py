"""Embedding whitening: principal directions of all distinct vectors, scaled to unit variance.

Tasks reduce centred rows to a triangle by QR, block by block; triangles are
reduced likewise, a few at a time, until one is left. It has the singular
values of all rows, so the covariance, which would square the errors, is never
formed. A bidiagonal solver takes values and directions from it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.bidiagonal import largest
from maskwright.plans.runtime import shared_folder

SCALE = 256
#: Entries of more than this are taken as this, with their sign.
LARGEST = 1 << 62
#: Rows that are reduced at once, and triangles.
BLOCK = 4096
FAN = 16
COMPONENTS = 4

SUMS = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("s", T.StringType())])
TRIANGLE = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("r", T.BinaryType())])
CELLS = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("s", T.DoubleType())])
WHITENED = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()),
    T.StructField("deviation", T.LongType()), T.StructField("whitened", T.DoubleType()),
    T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
])


@dataclass
class Fit:
    """What was learned from the distinct vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.directions / np.sqrt(self.values))


def whole(vector: Column) -> Column:
    """floor(256 c) of each entry, as longs; null for a vector that is null or holds null or non-finite entries."""
    doubles = F.transform(vector, lambda c: c.cast("double"))
    plain = F.forall(doubles, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rounded = F.transform(doubles, lambda c: F.when(F.abs(c * SCALE) < LARGEST, F.floor(c * SCALE)).otherwise(F.signum(c).cast("long") * LARGEST))
    return F.when(plain & (F.size(vector) > 0), rounded)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors (as a matrix) of each length in a column of lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    sizes = np.diff(offsets)
    for dim in np.unique(sizes):
        at = np.flatnonzero(sizes == dim)
        yield at, values[offsets[at][:, None] + np.arange(dim)]


def column_sums(x: np.ndarray) -> list[int]:
    if float(np.abs(x.astype(np.float64)).max(initial=0)) * len(x) < LARGEST:
        return [int(s) for s in x.sum(0)]
    return [sum(map(int, c)) for c in x.T]


def totals(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length: the number of vectors and the exact sum of each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for at, x in by_length(batch.column(0)):
                n, sums = held.get(x.shape[1], (0, [0] * x.shape[1]))
                held[x.shape[1]] = n + len(at), [a + b for a, b in zip(sums, column_sums(x), strict=True)]
        for dim, (n, sums) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(map(str, sums), pa.string())],
                SUMS.names,
            )

    found = fit.mapInArrow(run, SUMS).groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in found.orderBy("dim", "pos").collect():  # as many rows as a vector has entries
        out.setdefault(r["dim"], (r["n"], []))[1].append(int(r["s"]))
    return out


def reduced(stack: list[np.ndarray]) -> np.ndarray:
    """The triangle of all rows of some matrices."""
    rows = np.concatenate(stack)
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == r.shape[1] else np.concatenate((r, np.zeros((r.shape[1] - len(r), r.shape[1]))))


def triangles(fit: DataFrame, means: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """By length, the triangle R of all centred vectors: the product of R with itself is n times the covariance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in by_length(batch.column(0)):
                dim = x.shape[1]
                for at in range(0, len(x), BLOCK):
                    rows = x[at : at + BLOCK] - means[dim]
                    held[dim] = reduced([held[dim], rows] if dim in held else [rows])
        part = TaskContext.get().partitionId()
        for dim, r in held.items():
            yield triangle(dim, part, r)

    def triangle(dim: int, part: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part], pa.int32()), pa.array([r.tobytes()], pa.binary())], TRIANGLE.names)

    def fold(table: pa.Table) -> pa.Table:
        dim, part = table["dim"][0].as_py(), table["part"][0].as_py()
        stack = [np.frombuffer(r.as_py(), np.float64).reshape(dim, dim) for r in table["r"]]
        return pa.Table.from_batches([triangle(dim, part, reduced(stack))])

    parts = fit.mapInArrow(run, TRIANGLE)
    groups = fit.rdd.getNumPartitions()
    while groups > 1:
        groups = -(-groups // FAN)
        parts = parts.withColumn("part", F.pmod("part", F.lit(groups))).groupBy("dim", "part").applyInArrow(fold, TRIANGLE)
    # One triangle a length.
    return {r["dim"]: np.frombuffer(r["r"], np.float64).reshape(r["dim"], r["dim"]) for r in parts.toLocalIterator()}


def identity_errors(fit: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """By length, the largest entry of the whitened vectors' covariance minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in by_length(batch.column(0)):
                y = fits[x.shape[1]].project(x)
                cells = np.concatenate((y.sum(0), (y.T @ y).ravel()))
                held[x.shape[1]] = held.get(x.shape[1], 0.0) + cells
        for dim, cells in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(cells), pa.int32()), pa.array(range(len(cells)), pa.int32()), pa.array(cells)], CELLS.names)

    out = {}
    sums = fit.mapInArrow(run, CELLS).groupBy("dim", "cell").agg(F.sum("s").alias("s")).orderBy("dim", "cell").collect()
    for dim, own in fits.items():
        k = len(own.values)
        cells = np.array([r["s"] for r in sums if r["dim"] == dim]) / own.n
        covariance = cells[k:].reshape(k, k) - np.outer(cells[:k], cells[:k])
        out[dim] = float(np.abs(covariance - np.eye(k)).max(initial=0.0))
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """The sum of (n x - S)^2 of each row, exactly; null where a long can't hold it."""
    bound = max(float(n) * float(np.abs(x.astype(np.float64)).max(initial=0)) + max(map(abs, sums), default=0), 1.0)
    if bound * bound * x.shape[1] < LARGEST:
        rest = n * x - np.array(sums, np.int64)
        return pa.array((rest * rest).sum(1), pa.int64())
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())


def fitted(distinct: DataFrame, k: int) -> dict[int, Fit]:
    """A fit for each length of vectors. ``distinct`` has one column, each vector once."""
    counted = totals(distinct)
    means = {dim: np.array([s / n for s in sums]) for dim, (n, sums) in counted.items()}
    fits = {}
    for dim, r in triangles(distinct, means).items():
        n, sums = counted[dim]
        values, directions = largest(r, k)
        fits[dim] = Fit(n, sums, values / n, directions, float((r * r).sum()) / n)
    for dim, error in identity_errors(distinct, fits).items():
        fits[dim].identity_error = error
    return fits


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: ``k`` rows per vector.

    Vectors that are null or empty or hold null or non-finite entries take no
    part; a vector without a key does. Repeated vectors count once in the fit
    and are all whitened. Vectors of another length are fitted by themselves.
    Components without variance beyond rounding have no scale and give no
    rows, so fewer distinct vectors than k + 1 give fewer rows. Other columns
    are ignored; an empty table gives an empty result. Every task holds a block of
    vectors and triangles of their length; the driver one triangle a length.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), whole(F.col(vector)).alias("x")).where("x is not null")
    # A written table is read three times; small integers take a byte each in it.
    folder = f"{shared_folder(spark)}/whitening-{uuid.uuid4().hex}"
    rows.select("x").dropDuplicates().write.parquet(folder)
    fits = fitted(spark.read.schema("x array<bigint>").parquet(folder), k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in by_length(batch.column(1)):
                own = fits[x.shape[1]]
                m = len(own.values)
                if not m:
                    continue
                deviation = deviations(x, own.n, own.sums)
                each = np.repeat(np.arange(len(at)), m)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at[each])), pa.array(np.tile(np.arange(1, m + 1), len(at)), pa.int32()),
                    pa.array(np.full(len(each), own.n), pa.int64()), deviation.take(pa.array(each)), pa.array(own.project(x).ravel()),
                    pa.array(np.tile(own.values / own.trace, len(at))), pa.array(np.full(len(each), own.identity_error)),
                ], WHITENED.names)

    return rows.mapInArrow(run, WHITENED).withColumnRenamed("id", key)
