"""A quality classifier that compresses: what a text has in common with good and with bad ones.

Two zstandard dictionaries are built from chunks of good and of bad labelled
texts. Every text is compressed in chunks with either dictionary; the difference
of the two sizes, divided by the text's own, says which of them knows it better.
A logistic curve, fitted to labelled texts that are in no dictionary, makes it a
probability.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.plans.runtime import pin

#: A text is compressed in chunks of so many bytes, so that a long one, which would soon be its
#: own dictionary, is judged like a short one.
CHUNK = 512
LEVEL = 3
DICTIONARY_BYTES = 1 << 16
#: The dictionaries' bounded sample: of each label, the chunks of smallest hash, from the texts of smallest hash.
SAMPLE_TEXTS = 4096
SAMPLE_CHUNKS = 4096
#: Rows whose crc32 of the key has this remainder are held out.
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Calibration counts texts by their difference, in steps of this.
STEP = 1e-3

MEASURED = T.StructType([T.StructField("key", T.LongType()), T.StructField("difference", T.DoubleType())])
CHUNKS = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("chunk", T.BinaryType())])


@dataclass
class Model:
    """Dictionaries of bad (0) and good (1) texts; slope and offset of the curve."""

    bad: bytes
    good: bytes
    slope: float = 0.0
    offset: float = 0.0


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def chunks(text: memoryview) -> Iterator[memoryview]:
    for at in range(0, len(text), CHUNK):
        yield text[at : at + CHUNK]


def views(column: pa.Array) -> Iterator[memoryview]:
    """The bytes of each text; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else [0]
    data = memoryview(data if data is not None else b"")
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield data[a:b]


def dictionary(sample: list[bytes]) -> bytes:
    """A trained dictionary, or the sample itself where it is too small to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICTIONARY_BYTES]


class Sizes:
    """Compressed sizes of texts by one dictionary."""

    def __init__(self, content: bytes) -> None:
        plain = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        if content:
            known = zstandard.ZstdCompressionDict(content)
            known.precompute_compress(level=LEVEL)
            plain["dict_data"] = known
        self.compress = zstandard.ZstdCompressor(**plain).compress

    def of(self, text: memoryview) -> int:
        return sum(len(self.compress(x)) for x in chunks(text))


def differences(column: pa.Array, bad: Sizes, good: Sizes) -> np.ndarray:
    """(bad size - good size) / bytes: above 0 where the good dictionary knows a text better; 0 for no text."""
    return np.array([(bad.of(x) - good.of(x)) / len(x) if len(x) else 0.0 for x in views(column)], np.float64)


def training_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """``key``, ``label`` (0 or 1), ``for_dictionary``: one row per labelled key outside the held-out fold.

    Keys with both labels, without a key or with another label teach nothing.
    """
    known = labels.select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("key").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("key")))
    one = known.groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    return one.withColumn("for_dictionary", F.pmod(F.xxhash64(F.lit("dictionary"), "key"), F.lit(2)) == 0)


def sample_chunks(texts: DataFrame) -> DataFrame:
    """``label, hash, chunk``: of each label the chunks of smallest hash. ``texts`` has key, label, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: tuple[list, list] = ([], [])  # heaps of (-hash, chunk)
        for batch in batches:
            for key, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), views(batch.column(2)), strict=True):
                heap = best[label]
                for number, chunk in enumerate(chunks(text)):
                    entry = (-zlib.crc32(b"%d:%d" % (key, number)), bytes(chunk))
                    if len(heap) < SAMPLE_CHUNKS:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)
        for label, heap in enumerate(best):
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(heap), pa.int32()), pa.array([-h for h, _ in heap], pa.int64()), pa.array([c for _, c in heap], pa.binary())],
                CHUNKS.names,
            )

    return texts.select("key", "label", "text").mapInArrow(run, CHUNKS)


def dictionaries(docs: DataFrame, labels: DataFrame) -> Model:
    """``docs``: key, text; ``labels``: of training_labels()."""
    of_label = [labels.where(F.col("for_dictionary") & (F.col("label") == x)).orderBy(F.xxhash64("key"), "key").limit(SAMPLE_TEXTS) for x in (0, 1)]
    chosen = of_label[0].unionByName(of_label[1]).select("key", "label")
    # At most twice SAMPLE_TEXTS rows of a key and a label.
    found = pin(sample_chunks(docs.join(F.broadcast(chosen), "key")))
    made = []
    for x in (0, 1):
        # The driver gets the chosen chunks only: their largest hash is found first, without chunks.
        own = found.where(F.col("label") == x)
        last = own.select("hash").orderBy("hash").limit(SAMPLE_CHUNKS).agg(F.max("hash")).first()[0]
        rows = sorted((r["hash"], bytes(r["chunk"])) for r in own.where(F.col("hash") <= F.lit(last)).collect())
        made.append(dictionary([chunk for _, chunk in rows[:SAMPLE_CHUNKS]]))
    return Model(*made)


def measure(docs: DataFrame, model: Model) -> DataFrame:
    """``key, difference`` of every row."""
    bad_content, good_content = model.bad, model.good

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, good = Sizes(bad_content), Sizes(good_content)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(differences(batch.column(1), bad, good))], MEASURED.names)

    return docs.select("key", "text").mapInArrow(run, MEASURED)


def curve(difference: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through counts of good and bad texts.

    Counts are drawn a little to the middle, as if one text more had the other label, so the curve
    has an end also where a difference tells all texts apart. Without texts of both labels it is flat.
    """
    n_good, n_bad = good.sum(), bad.sum()
    base = math.log((n_good + 1) / (n_bad + 1))
    if not n_good or not n_bad:
        return 0.0, base
    n = (good + bad).astype(float)
    target = (good * (n_good + 1) / (n_good + 2) + bad / (n_bad + 2)) / n
    mean = np.average(difference, weights=n)
    scale = math.sqrt(np.average((difference - mean) ** 2, weights=n)) or 1.0
    x = np.stack(((difference - mean) / scale, np.ones(len(n))), 1)

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((n * (np.logaddexp(0, z) - target * z)).sum())

    beta = np.array([0.0, base])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -700, 700)))
        step = np.linalg.solve(x.T @ ((n * p * (1 - p))[:, None] * x) + 1e-9 * np.eye(2), x.T @ (n * (target - p)))
        size = 1.0
        while size > 1e-6 and loss(beta + size * step) > loss(beta):
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-10:
            break
    return float(beta[0] / scale), float(beta[1] - beta[0] * mean / scale)


def calibrate(measured: DataFrame, labels: DataFrame, model: Model) -> Model:
    """All labelled texts that are in no dictionary, counted by their difference."""
    bins = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("difference"))) / STEP).cast("int")
    rows = (
        measured.join(labels.where(~F.col("for_dictionary")), "key").groupBy(bins.alias("bin"))
        .agg(F.sum("label").alias("good"), F.sum(1 - F.col("label")).alias("bad")).orderBy("bin").collect()  # at most 2 / STEP + 1
    )
    table = np.array([tuple(r) for r in rows], float).reshape(-1, 3)
    model.slope, model.offset = curve(table[:, 0] * STEP, table[:, 1], table[:, 2])
    return model


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``key, held_out, score, predicted``: one row per row of ``docs``.

    Learns from labelled rows outside the held-out fold only: half of them (by
    hash; a bounded sample) for the dictionaries, the other half, all of it, for
    the curve. Null and empty texts have the difference 0; rows without a key
    are scored and not held out; repeated rows are each scored; other columns
    are ignored; without labels every score is 0.5. Texts are read once for the
    sample and once to be compressed, whole, and are never shuffled.
    """
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    known = pin(training_labels(labels, key, label))
    model = dictionaries(docs, known)
    measured = pin(measure(docs, model))
    model = calibrate(measured, known, model)
    score = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("difference") + F.lit(model.offset))))
    scored = measured.select("key", held_out(F.col("key")).alias("held_out"), score.alias("score"))
    return scored.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
