"""Exact top-k inner products, pruned by segment statistics at several resolutions.

A vector is cut into segments; of each, its mean and deviation are kept. For
two vectors the sum over segments of ``m (mean mean' + dev dev')`` is at least
their inner product (the deviations' part by Cauchy and Schwarz), which is the
same as a lower bound on their distance, and finer segments bound closer. A
block of queries meets a block of candidates; coarse bounds come first, finer
ones for what is left, and exact products for the survivors only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.plans.runtime import partitions, pin

SCALE = 256
#: Vectors of a block of candidates, and of queries.
CANDIDATES = 2048
QUERIES = 512
#: Segments at each resolution, coarse to fine.
RESOLUTIONS = (4, 16, 32)
#: Products of this size and more are not exact in doubles.
EXACT = float(1 << 52)

#: Pairs whose products are taken together.
AT_ONCE = 1 << 14
#: Scores that a long can't hold are ranked exactly and given as this.
LIMIT = (1 << 63) - 1

PACKED = T.StructType([
    T.StructField("dim", T.IntegerType()), T.StructField("block", T.LongType()),
    T.StructField("ids", T.BinaryType()), T.StructField("data", T.BinaryType()),
])
FOUND = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def integers(vector: Column) -> Column:
    """floor(256 x) of each component as a double; null for a vector that takes no part."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    plain = F.forall(doubles, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = F.transform(doubles, lambda x: _floor(x * SCALE))
    return F.when(plain & (F.size(vector) > 0), whole)


def _floor(x: Column) -> Column:
    # floor() gives a long; beyond 2^52 a double is whole already.
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def pack(rows: DataFrame, size: int) -> DataFrame:
    """Rows ``id``, ``v`` as blocks of up to ``size`` vectors of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, vectors = held.pop(dim)
            code = np.array(ids, np.int64)
            # A block's name only spreads blocks over tasks.
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([int(np.bitwise_xor.reduce(code * 2654435761)) + len(ids)], pa.int64()),
                 pa.array([code.tobytes()], pa.binary()), pa.array([np.stack(vectors).tobytes()], pa.binary())], PACKED.names
            )

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                vector = np.asarray(v.values, np.float64)
                ids, vectors = held.setdefault(len(vector), ([], []))
                ids.append(i)
                vectors.append(vector)
                if len(ids) == size:
                    yield out(len(vector))
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(run, PACKED)


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Per vector, means and deviations times the root of the segment's length."""
    edges = np.linspace(0, vectors.shape[1], min(segments, vectors.shape[1]) + 1).astype(int)
    length = np.diff(edges)
    mean = np.add.reduceat(vectors, edges[:-1], 1) / length
    rest = vectors - np.repeat(mean, length, 1)
    with np.errstate(over="ignore"):
        spread = np.sqrt(np.add.reduceat(rest * rest, edges[:-1], 1))
    return np.hstack((mean * np.sqrt(length), spread))


def products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of rows i of a and j of b, as integers, some at a time."""
    if len(i) and (np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]) >= EXACT:
        return np.array([sum(int(x) * int(y) for x, y in zip(a[p], b[q], strict=True)) for p, q in zip(i, j, strict=True)], object)
    out = np.empty(len(i), np.int64)
    for begin in range(0, len(i), AT_ONCE):
        part = slice(begin, begin + AT_ONCE)
        out[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]])
    return out


def search(queries: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """For each query its ``k`` best candidates here, ties to smaller ids, but for its own id."""
    other = query_ids[:, None] != ids[None, :]
    n = len(ids)
    bound = np.full((len(queries), n), np.inf)
    alive = other
    best = np.full(len(queries), -np.inf)
    for segments in RESOLUTIONS:
        if segments > vectors.shape[1] and segments != RESOLUTIONS[0]:
            break
        q, c = statistics(queries, segments), statistics(vectors, segments)
        with np.errstate(over="ignore", invalid="ignore"):  # what overflows bounds nothing
            slack = 1e-9 * (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]) + 1e-6
            now = q @ c.T + slack
        bound = np.minimum(bound, np.where(np.isnan(now), np.inf, now))
        alive = alive & (bound >= best[:, None])
        if segments == RESOLUTIONS[0]:
            # The most promising ones set the bar: the k-th best of some is at most the k-th best of all.
            first = np.argpartition(np.where(alive, -bound, np.inf), min(4 * k, n) - 1, axis=1)[:, : min(4 * k, n)]
            rows = np.repeat(np.arange(len(queries)), first.shape[1])
            score = products(queries, rows, vectors, first.ravel()).astype(np.float64).reshape(first.shape)
            score = np.where(np.take_along_axis(other, first, 1), score, -np.inf)
            if first.shape[1] >= k:
                best = np.sort(score, 1)[:, -k]
            best = best - 1e-9 * np.abs(np.where(np.isfinite(best), best, 0))
            alive = alive & (bound >= best[:, None])
    row, column = np.nonzero(alive)
    score = products(queries, row, vectors, column)
    order = np.lexsort((ids[column], -score, row)) if score.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], ids[column[i]])), int)
    row, column, score = row[order], column[order], score[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    top = place < k
    score = np.array([max(-LIMIT, min(LIMIT, x)) for x in score[top]], np.int64) if score.dtype == object else score[top]
    return query_ids[row[top]], ids[column[top]], score


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` highest scores of each query.

    Vectors that are null, empty or hold null or non-finite components take no
    part, nor do rows without a key; vectors of another dimension than the query's are not compared
    with it. Repeated rows are all candidates, and a repeated query is asked
    once; rows with the query's key are not its candidates. Of rows with one key and
    different vectors any one may be asked: keys are meant to be unique. Every block of queries meets every block of candidates of its
    dimension; a task holds one block of each, and hands on k rows per query.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), integers(F.col(vector)).alias("v"), is_query.alias("q")).where("v is not null and id is not null")
    candidates = pin(pack(rows.select("id", "v"), CANDIDATES))
    asked = pin(rows.where("q").select("id", "v").dropDuplicates(["id"]))
    asked = pack(asked.repartition(max(1, -(-asked.count() // QUERIES)), "id"), QUERIES)
    # Candidates are dealt into so many hands; each hand is dealt all queries.
    hands = max(1, min(candidates.count(), partitions(vectors.sparkSession)))
    candidates = candidates.withColumn("hand", F.pmod(F.hash("block"), F.lit(hands)))
    asked = asked.select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data")).withColumn(
        "hand", F.explode(F.sequence(F.lit(0), F.lit(hands - 1)))
    )
    # Queries, once for every hand, may look small to the optimizer; the driver could not hold them.
    met = candidates.join(asked.hint("merge"), ["dim", "hand"]).select("dim", "q_ids", "q_data", "ids", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                dim, q_ids, q_data, ids, data = (c[r].as_py() for c in batch.columns)
                got = search(
                    np.frombuffer(q_data, np.float64).reshape(-1, dim), np.frombuffer(data, np.float64).reshape(-1, dim),
                    np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64), k,
                )
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], FOUND.names)

    found = met.mapInArrow(run, FOUND)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
