"""Byte-level BPE of whole texts, with content-defined chunks encoded once.

A rolling hash over words cuts each text where its content says so; copied
passages are thus cut alike wherever they stand. Texts with the same smallest
chunk hash are brought together, and inside a task a chunk that was met before
is not encoded again. What stands around a cut is then encoded anew, in a
window that grows until both its ends are places where any encoding of the
text must begin a new token: there the pieces agree with the whole.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.words import Texts, grams, mix, pieces, span_hash, words

#: Words in the rolling window; one window in CUT_EVERY ends a chunk.
WINDOW = 4
CUT_EVERY = 64
#: Encoded chunks that a task keeps, in bytes of their text.
CACHE_BYTES = 24 << 20
#: A piece without a sure boundary that is longer goes to the slower library.
LONG_PIECE = 1 << 14

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
VISIBLE = np.zeros(256, bool)
VISIBLE[range(0x21, 0x7F)] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where chunks begin inside the texts (bytes), and each chunk's row and content hash.

    The row's own start begins a chunk too, also that of an empty text.
    """
    found = words(texts)
    prefix = texts.hashes()
    rolled, at = grams(span_hash(prefix, found.start, found.end), found.row, WINDOW)
    after = at[rolled % CUT_EVERY == 0] + WINDOW
    after = after[after < len(found.row)]
    after = after[found.row[after] == found.row[after - 1]]
    begin = np.concatenate((texts.starts[:-1], found.start[after]))
    row = np.concatenate((np.arange(len(texts)), found.row[after]))
    # An empty row shares its start with the next row: order by row as well.
    order = np.lexsort((begin, row))
    begin, row = begin[order], row[order]
    if len(begin) > 1:
        fresh = np.append(True, (begin[1:] != begin[:-1]) | (row[1:] != row[:-1]))
        begin, row = begin[fresh], row[fresh]
    return begin, row, span_hash(prefix, begin, np.append(begin[1:], len(texts.data)))


def place_of(column: pa.Array) -> pa.Array:
    """For each text the smallest hash of its chunks: copies and near copies mostly share it."""
    out = []
    for texts in pieces(column):
        _, row, hashes = cuts(texts)
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        out.append(np.minimum.reduceat(mix(hashes), first))
    return pa.array(np.concatenate(out).view(np.int64) if out else [], pa.int64())


@F.arrow_udf(T.LongType())
def place(text: pa.Array) -> pa.Array:
    return place_of(text)


class Codec:
    """Encodes pieces of text with one tokenizer file and keeps what it has encoded."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        model = json.loads(self.whole.to_str())
        letters = _byte_letters()
        self.bytes_of = {
            i: bytes(letters[c] for c in token) for token, i in model["model"]["vocab"].items()
        }
        added = {x["content"]: x["id"] for x in model["added_tokens"]}
        self.bytes_of |= {i: token.encode() for token, i in added.items()}
        self.digits = {i: str(i) for i in self.bytes_of}
        self.added = [token.encode() for token in added]
        self.fast = _ranks(self.bytes_of, added)
        self.new: dict[bytes, tuple[int, str, bytes]] = {}
        self.old: dict[bytes, tuple[int, str, bytes]] = {}
        self.held = 0

    def ids(self, piece: bytes) -> list[int]:
        """Of a piece that begins and ends where tokens must."""
        text = piece.decode()
        # Letters and digits below U+0530 are the same in all versions of Unicode in use.
        if len(piece) <= LONG_PIECE and (not text or max(text) < "԰") and not any(a in piece for a in self.added):
            return self.fast.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids

    def piece(self, piece: bytes) -> tuple[int, str, bytes]:
        """Number of tokens, their ids joined by commas, and what they decode to."""
        got = self.new.get(piece)
        if got is None:
            got = self.old.get(piece)
            if got is None:
                ids = self.ids(piece)
                got = len(ids), ",".join([self.digits[i] for i in ids]), b"".join([self.bytes_of[i] for i in ids])
            self.held += 3 * len(piece) + 400
            if self.held > CACHE_BYTES:
                self.old, self.new, self.held = self.new, {}, 0
            self.new[piece] = got
        return got


@functools.lru_cache(maxsize=1)
def codec_of(path: str) -> Codec:
    """One codec per worker process, with what it has encoded, for all its tasks."""
    return Codec(path)


def _byte_letters() -> dict[str, int]:
    """Which letter stands for which byte in a byte-level vocabulary: visible ones for
    themselves, all others for letters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def _ranks(bytes_of: dict[int, bytes], added: dict[str, int]):
    """The same vocabulary for the faster library: a byte-level id is its merge's rank."""
    import public_tokenizers
    import tiktoken

    ranks = {token: i for i, token in bytes_of.items() if i not in added.values()}
    return tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def segments(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces begin, and their rows: chunks without their edges, and the windows around cuts.

    A sure boundary is before a single space that follows a visible ASCII
    character and precedes an ASCII letter: no token holds a space behind
    another character, and the space goes with the letter.
    """
    data = texts.data
    begin, row, _ = cuts(texts)
    sure = np.zeros(len(data), bool)
    if len(data) > 2:
        sure[1:-1] = (data[1:-1] == 0x20) & LETTER[data[2:]] & VISIBLE[data[:-2]]
        inner = texts.starts[1:-1]
        sure[inner[inner < len(data)]] = False  # a row begins there
        inner = inner[inner > 0] - 1
        sure[inner] = False  # its letter is of the next row
    at = np.flatnonzero(sure)
    inside = begin != texts.starts[row]
    cut, where = begin[inside], row[inside]
    low, high = texts.starts[where], texts.starts[where + 1]
    padded = np.concatenate(([-1], at, [len(data)]))
    k = np.searchsorted(padded, cut, "left")
    left, right = np.maximum(padded[k - 1], low), np.minimum(padded[k], high)
    rows = np.arange(len(texts))
    edges = np.concatenate((texts.starts[:-1], left, right))
    owner = np.concatenate((rows, where, where))
    good = edges < texts.starts[owner + 1]
    good[: len(rows)] = True
    pairs = np.unique(np.stack((owner[good], edges[good]), 1), axis=0)
    return pairs[:, 1], pairs[:, 0]


def encode_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    codec = codec_of(path)
    for batch in batches:
        for texts in pieces(batch.column(1)):
            begin, row = segments(texts)
            data, ends = texts.data.tobytes(), np.append(begin[1:], len(texts.data)).tolist()
            got = [codec.piece(data[b:e]) for b, e in zip(begin.tolist(), ends, strict=True)]
            bounds = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
            counts, ids, decoded = [], [], []
            for i in range(len(texts)):
                own = got[bounds[i] : bounds[i + 1]]
                counts.append(sum(x[0] for x in own))
                ids.append(hashlib.sha256(",".join([x[1] for x in own if x[1]]).encode()).hexdigest())
                text = b"".join([x[2] for x in own]).decode("utf-8", "replace")
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(texts.first, len(texts)), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)],
                ["_key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def gathered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``_key`` and ``_text``, with copies and near copies in the same tasks.

    Rebalancing lets Spark split a hot group over tasks; each then encodes the
    group's chunks once.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.withColumn("_place", place("_text")).hint("rebalance", F.col("_place")).select("_key", "_text")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``: one row per row of ``docs``.

    Null texts are empty (no tokens); a special token spelled out in a text is
    that token. Repeated rows, null keys and other columns are allowed.
    """
    path = path or default_tokenizer()
    rows = gathered(docs, key, text)
    schema = T.StructType([
        T.StructField("_key", rows.schema["_key"].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])
    return rows.mapInArrow(lambda x: encode_batches(x, path), schema).withColumnRenamed("_key", key)


def encode_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key`` and ``ids``: the token ids themselves, for training files."""
    path = path or default_tokenizer()
    rows = gathered(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(path)
        for batch in batches:
            for texts in pieces(batch.column(1)):
                begin, row = segments(texts)
                data, ends = texts.data.tobytes(), np.append(begin[1:], len(texts.data)).tolist()
                out: list[list[int]] = [[] for _ in range(len(texts))]
                for b, e, r in zip(begin.tolist(), ends, row.tolist(), strict=True):
                    joined = codec.piece(data[b:e])[1]
                    out[r] += [int(i) for i in joined.split(",")] if joined else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first, len(texts)), pa.array(out, pa.list_(pa.int32()))], ["_key", "ids"]
                )

    schema = T.StructType([T.StructField("_key", rows.schema["_key"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema).withColumnRenamed("_key", key)
