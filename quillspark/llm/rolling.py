"""Words and rolling hashes of whole Arrow batches of texts, in numpy, without a Python object per word.

All functions work on the UTF-8 bytes of a block of texts laid end to end. A block is a run of
texts of bounded total size (one text may be larger), so memory does not depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words by letters and digits: ASCII digits and letters, and every non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes that begin a character.
LEAD = (np.arange(256) & 0xC0) != 0x80


class Block:
    """Some texts: data (bytes), offsets (one more than texts), and the index of the first text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int) -> None:
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of word bytes, and for each text the index of its
        first word (one more entry than texts). Runs end with their text."""
        inside = is_word[self.data]
        edge = self.offsets[:-1][np.diff(self.offsets) > 0]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        start[edge] = inside[edge]
        last = self.offsets[1:][np.diff(self.offsets) > 0] - 1
        end = inside.copy()
        end[:-1] &= ~inside[1:]
        end[last] = inside[last]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def prefix(self, data: np.ndarray | None = None) -> "Prefix":
        return Prefix(self.data if data is None else data)


class Prefix:
    """Polynomial hashes of any byte range in constant time, modulo 2^64."""

    powers = np.cumprod(np.full(BLOCK_BYTES + 1, BASE), dtype=np.uint64)
    inverses = np.cumprod(np.full(BLOCK_BYTES + 1, np.uint64(pow(int(BASE), -1, 1 << 64))), dtype=np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        if len(data) >= len(Prefix.powers):
            Prefix.powers = np.cumprod(np.full(len(data) + 1, BASE), dtype=np.uint64)
            Prefix.inverses = np.cumprod(
                np.full(len(data) + 1, np.uint64(pow(int(BASE), -1, 1 << 64))), dtype=np.uint64)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * Prefix.powers[:len(data)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * Prefix.inverses[starts])


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield Block(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], i)
        i = j


def grams(words: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n consecutive words of one text, and for each text the index of its first
    n-gram. bounds holds each text's first word. n-grams that would cross a text are left out."""
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    at = np.arange(first[-1]) + np.repeat(bounds[:-1] - first[:-1], counts)
    value = words[at]
    for k in range(1, n):
        value = mix(value * BASE + words[at + k])
    return value, first


def repeated(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks the values that occur twice or more within their text. first: see grams."""
    keyed = values + np.repeat(mix(np.arange(1, len(first), dtype=np.uint64)), np.diff(first))
    ordered = np.sort(keyed)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(twice, keyed), len(twice) - 1)
    return twice[at] == keyed


def covered(marks: np.ndarray, first: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """Marks the words that lie inside any marked n-gram."""
    change = np.zeros(bounds[-1] + 1, np.int64)
    counts = np.diff(first)
    at = np.arange(first[-1]) + np.repeat(bounds[:-1] - first[:-1], counts)
    at = at[marks]
    change[at] += 1
    np.add.at(change, at + n, -1)
    return np.cumsum(change[:-1]) > 0


def totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values between neighbouring bounds."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[bounds])
