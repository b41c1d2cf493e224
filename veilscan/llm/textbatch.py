"""Vectorised text kernels over Arrow string columns: words, shingle hashes.

Everything here works on the UTF-8 buffer of a whole column slice, so the cost
per byte is a few numpy passes and never a Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD1342543DE82EF95)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the public splitmix64 generator, element-wise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, len(col) + 1 + col.offset)[col.offset:]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``most`` bytes (a longer row stands alone)."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        out = []
        for base in (_BASE, _BASE_INV):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if n > 1 << 22:  # very long texts: do not keep the tables
            return out[0], out[1]
        _powers = (out[0], out[1])
    return _powers


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each word's row."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = np.empty(len(raw), bool)
    before[0], before[1:] = True, ~word[:-1]
    after = np.empty(len(raw), bool)
    after[-1], after[:-1] = True, ~word[1:]
    starts = np.flatnonzero(word & (before | edge[:-1]))
    ends = np.flatnonzero(word & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal exactly when the spans' bytes are (up to hash collisions)."""
    power, inverse = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every window of n words (crossing row borders; the caller masks those)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * _STEP + words[k:len(words) - n + 1 + k]
    return mix64(out)


def shingle_sets(raw: np.ndarray, off: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of each row (A-Z lower-cased).

    A row of fewer than n words has its whole word sequence as its one shingle;
    a row without words has none.
    """
    starts, ends, row = word_spans(raw, off)
    rows = len(off) - 1
    if not len(starts):
        return [np.zeros(0, np.uint64)] * rows
    words = word_hashes(LOWER[raw], starts, ends)
    first = np.searchsorted(row, np.arange(rows + 1))
    grams = window_hashes(words, n)
    out = []
    for r in range(rows):
        a, b = first[r], first[r + 1]
        if b - a >= n:
            out.append(np.unique(grams[a:b - n + 1]))
        elif b > a:
            out.append(window_hashes(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
