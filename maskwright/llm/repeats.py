"""Repeated passages by a sparse suffix array.

Of all suffixes of all texts only those at minimisers are kept: in every window
of LENGTH words the twelve words of smallest hash. They are sorted by content,
first of the twelve words, then of all words of the windows that chose them,
and each is compared with its neighbours. Neighbours that agree in all are
repeated whole. Where only the twelve words agree, the match is extended to the
left and to the right: the windows around are sorted and compared likewise, and
those of a suffix that is repeated whole count at all their places in its text.
Windows that are repeated are joined to passages.

A passage of LENGTH words or more has the same minimisers wherever it stands, so
none is missed; each task sorts an equal share, also of a passage that a third
of all texts hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.words import Texts, _Powers, grams, mix, pieces, span_hash, words
from maskwright.plans.runtime import partitions, pin

#: Passages of at least so many words are found.
LENGTH = 50
#: Words of a minimiser.
SEED = 12


def word_hashes(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    found = words(texts)
    return span_hash(texts.hashes(), found.start, found.end), found.row


def prefix_of(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any run of words follows."""
    up, _ = _Powers.of(len(hashes) + 1)
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes) * up[: len(hashes)], out=out[1:])
    return out


def minimisers(hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share a minimiser: first window, number of windows, minimiser's hash."""
    total = len(hashes) - LENGTH + 1
    if total <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    seed = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
    value, at = grams(hashes, row, SEED)
    seed[at] = value
    best, width, span = np.arange(len(hashes)), 1, LENGTH - SEED + 1

    def smaller(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(seed[a] <= seed[b], a, b)  # the first of equal ones

    while 2 * width <= span:
        best = smaller(best[:-width], best[width:])
        width *= 2
    rest = span - width
    best = smaller(best[: len(best) - rest], best[rest:])[:total]
    whole = np.flatnonzero(row[:total] == row[LENGTH - 1 :])
    best = best[whole]
    new = np.flatnonzero(np.append(True, (best[1:] != best[:-1]) | (whole[1:] != whole[:-1] + 1))) if len(whole) else whole
    return whole[new], np.diff(np.append(new, len(whole))), seed[best[new]]


def by_content(owner: np.ndarray, key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """First of each distinct (owner, key), the starts of all of them, and their order."""
    order = np.lexsort((start, key, owner))
    o, k = owner[order], key[order]
    first = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (k[1:] != k[:-1]))) if len(o) else np.zeros(0, np.int64)
    return order[first], pa.ListArray.from_arrays(pa.array(np.append(first, len(o)), pa.int32()), pa.array(start[order], pa.int32())), order


def rows_out(batch: pa.RecordBatch, texts: Texts, owner: np.ndarray, columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    """Columns with the ``_key`` and ``_th`` of their texts."""
    took = pa.array(texts.first + owner, pa.int64())
    return pa.RecordBatch.from_arrays([batch.column("_key").take(took), batch.column("_th").take(took), *columns], ["_key", "_th", *names])


def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in pieces(batch.column("_text")):
            hashes, row = word_hashes(texts)
            start, number, seed = minimisers(hashes, row)
            prefix, first = prefix_of(hashes), np.searchsorted(row, np.arange(len(texts)))
            whole = span_hash(prefix, start, start + number + LENGTH - 1)
            owner = row[start]
            one, starts, _ = by_content(owner, whole, start - first[owner])
            yield rows_out(batch, texts, owner[one], [
                pa.array(seed[one].view(np.int64)), pa.array(whole[one].view(np.int64)), starts, pa.array(number[one], pa.int32()),
            ], ["h", "s", "starts", "n"])


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows that each text's ``probes`` (first window, number, whether the
    suffix is whole in another row) name.

    A window that lies in a suffix which another row has is ``known`` to be repeated, wherever
    else it stands in its own text: no probe of that other row needs to be there.
    """
    for batch in batches:
        column = batch.column("probes")
        for texts in pieces(batch.column("_text")):
            hashes, row = word_hashes(texts)
            prefix, first = prefix_of(hashes), np.searchsorted(row, np.arange(len(texts)))
            probes = column.slice(texts.first, len(texts))
            flat = probes.flatten()
            owner = np.repeat(np.arange(len(texts)), np.asarray(probes.value_lengths()))
            begin, number = np.asarray(flat.field(0)).astype(np.int64), np.asarray(flat.field(1)).astype(np.int64)
            owner, whole = np.repeat(owner, number), np.repeat(np.asarray(flat.field(2)).astype(bool), number)
            at = np.repeat(begin - np.append(0, np.cumsum(number)[:-1]), number) + np.arange(number.sum())
            key = span_hash(prefix, first[owner] + at, first[owner] + at + LENGTH) if len(at) else np.zeros(0, np.uint64)
            one, starts, order = by_content(owner, key, at)
            n = len(one)
            known = np.logical_or.reduceat(whole[order], np.asarray(starts.offsets)[:-1]) if n else np.zeros(0, bool)
            yield rows_out(batch, texts, owner[one], [
                pa.array(key[one].view(np.int64)), pa.array(np.zeros(n, np.int64)), starts, pa.array(np.ones(n, np.int32)), pa.array(known),
            ], ["h", "s", "starts", "n", "known"])


def compared(rows: DataFrame) -> DataFrame:
    """Sort by content and add, from both neighbours, ``same`` (h and s agree) and ``near`` (only h).

    Rows are range-partitioned by content and document, so that equal content
    spreads over tasks; each partition also knows the rows just outside it.
    """
    order = ["h", "s", "_th", "_key"]
    ranged = pin(
        rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
    )
    content = F.struct("h", "s")
    # Two rows per partition.
    edges = sorted(ranged.groupBy("_part").agg(F.min(content).alias("a"), F.max(content).alias("b")).collect())
    before = {here[0]: tuple(earlier[2]) for earlier, here in zip(edges, edges[1:], strict=False)}
    after = {here[0]: tuple(later[1]) for here, later in zip(edges, edges[1:], strict=False)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flags(batch: pa.RecordBatch, left: tuple | None, right: tuple | None) -> pa.RecordBatch:
            h, s = np.asarray(batch.column("h")), np.asarray(batch.column("s"))
            n = len(h)
            like, same = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
            like[1:n], same[1:n] = h[1:] == h[:-1], s[1:] == s[:-1]
            if left:
                like[0], same[0] = h[0] == left[0], s[0] == left[1]
            if right:
                like[n], same[n] = h[-1] == right[0], s[-1] == right[1]
            whole, part = like & same, like & ~same
            return pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(whole[1:] | whole[:-1]), pa.array(part[1:] | part[:-1])], [*names, "same", "near"]
            )

        held, left = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            first = batch.column("h")[0].as_py(), batch.column("s")[0].as_py()
            if held is None:
                left = before.get(batch.column("_part")[0].as_py())
            else:
                yield flags(held, left, first)
                left = held.column("h")[-1].as_py(), held.column("s")[-1].as_py()
            held = batch
        if held is not None:
            yield flags(held, left, after.get(held.column("_part")[0].as_py()))

    names = rows.columns
    schema = T.StructType([*rows.schema, T.StructField("same", T.BooleanType()), T.StructField("near", T.BooleanType())])
    return ranged.mapInArrow(run, schema)


SPANS = T.ArrayType(T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("end_word", T.IntegerType())]))


@F.arrow_udf(SPANS)
def joined(spans: pa.Array) -> pa.Array:
    """Overlapping and touching spans of each text as one."""
    lengths, flat = np.asarray(spans.value_lengths()), spans.flatten()
    owner = np.repeat(np.arange(len(spans)), lengths)
    start, end = (np.asarray(flat.field(k)).astype(np.int64) for k in (0, 1))
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    far = np.int64(1) << 40
    reach = np.maximum.accumulate(end + owner * far) - owner * far
    new = np.append(True, (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])) if len(owner) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    close = np.append(at[1:], len(owner)) - 1 if len(at) else at
    items = pa.StructArray.from_arrays([pa.array(start[at], pa.int32()), pa.array(reach[close], pa.int32())], ["first_word", "end_word"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[at], np.arange(len(spans) + 1)), pa.int32()), items)


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``first_word``, ``end_word``: maximal runs of words all of whose LENGTH-word windows
    stand in another row as well.

    Words are numbered from 0, the end is exclusive. Null, empty and short texts
    have none; a row repeated whole repeats its passages as any copy does, and
    they are listed once; other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_th"), F.col(text).alias("_text"))
    schema = T.StructType([
        rows.schema["_key"], rows.schema["_th"], T.StructField("h", T.LongType()), T.StructField("s", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("n", T.IntegerType()),
    ])
    anchors = pin(compared(rows.mapInArrow(suffixes, schema)).where("same or near"))
    probes = anchors.where("near").select("_key", "_th", "n", "same", F.explode("starts").alias("start")).groupBy("_key", "_th").agg(
        F.collect_list(F.struct("start", "n", "same")).alias("probes")
    ).select(F.col("_key").alias("_pk"), F.col("_th").alias("_pt"), "probes")
    around = rows.join(probes, F.col("_key").eqNullSafe(F.col("_pk")) & F.col("_th").eqNullSafe(F.col("_pt"))).drop("_pk", "_pt")
    extended = compared(around.mapInArrow(windows, T.StructType([*schema, T.StructField("known", T.BooleanType())]))).where("same or known")
    found = anchors.where("same").select(*schema.names).unionByName(extended.select(*schema.names))
    spans = found.select("_key", "_th", F.explode("starts").alias("start"), "n").groupBy("_key", "_th").agg(
        F.collect_list(F.struct("start", (F.col("start") + F.col("n") + LENGTH - 1).alias("end"))).alias("spans")
    )
    return spans.select("_key", F.explode(joined("spans")).alias("x")).select(F.col("_key").alias(key), "x.*")
