"""Words, lines and their hashes for whole Arrow batches, in numpy.

A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D. Those bytes
never occur inside a longer UTF-8 sequence, so bytes and characters agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are analysed together; one longer text goes alone.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
CONTINUATION = (np.arange(256) & 0xC0) == 0x80

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(20).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, for positions up to the longest text seen."""

    up = powers(_BASE, 1)
    down = powers(_INVERSE, 1)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = max(n, CHUNK_BYTES + 1)
            if size > 8 * CHUNK_BYTES:  # used once, not kept
                return powers(_BASE, size), powers(_INVERSE, size)
            cls.up, cls.down = powers(_BASE, size), powers(_INVERSE, size)
        return cls.up, cls.down


@dataclass
class Texts:
    """Some rows of a string column: ``data[starts[i]:starts[i + 1]]`` is row i; null is empty."""

    first: int
    data: np.ndarray
    starts: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """How many flags are set in each row's bytes."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return np.diff(total[self.starts])

    def hashes(self) -> np.ndarray:
        """Prefix sums from which ``span_hash`` takes the hash of any stretch of bytes."""
        up, _ = _Powers.of(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_LETTERS[self.data] * up[: len(self.data)], out=out[1:])
        return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch that depends on its bytes only."""
    _, down = _Powers.of(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def pieces(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Cut a string column into runs of rows with at most ``limit`` bytes, or one row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Texts(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


@dataclass
class Words:
    """``row``: of each word, within its Texts; ``start`` and ``end`` in bytes."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def counts(self, rows: int) -> np.ndarray:
        return np.bincount(self.row, minlength=rows)


def words(texts: Texts) -> Words:
    solid = ~SPACE[texts.data]
    n = len(solid)
    border = np.zeros(n + 1, bool)
    border[texts.starts] = True
    fresh = border.copy()
    fresh[1:] |= ~np.append(solid, False)[:-1]
    start = np.flatnonzero(solid & fresh[:-1])
    over = border[1:].copy()
    over[:-1] |= ~solid[1:]
    end = np.flatnonzero(solid & over) + 1
    row = np.searchsorted(texts.starts, start, "right") - 1
    return Words(row, start, end)


def grams(hashes: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of one row, and where each begins."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    factor = powers(_BASE, size + 1)[1:]
    for k in range(size):
        total += hashes[k : k + n] * factor[k]
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    return mix(total[at]), at


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.empty(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out
