"""Vectorised scans of UTF-8 text held in Arrow buffers.

Words are the maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; those bytes never occur inside a
multi-byte UTF-8 sequence, so byte runs and code-point runs are the same. All functions take whole
texts; a batch is only cut between rows, so memory follows the longest text and ``CHUNK_BYTES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = powers(4096)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column, its row offsets (n + 1) and which rows are not null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid()) if n else np.zeros(0, bool)
    return raw, at, valid


def row_chunks(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes, or one longer row alone."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, row_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of ``data``; a row start always ends the word before it."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~IS_SPACE[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = False
    edge[row_starts] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are in order and do not overlap.

    What it holds beside the result follows ``CHUNK_BYTES`` or the longest span.
    """
    out = np.zeros(len(starts), np.uint64)
    upto, i = np.cumsum(ends - starts), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + CHUNK_BYTES, side="right")))
        out[i:j] = _span_hashes(data, starts[i:j], ends[i:j])
        i = j
    return out


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lens = ends - starts
    table = _POWERS if lens.max() <= len(_POWERS) else powers(int(lens.max()))
    total = np.cumsum(lens)
    within = np.arange(total[-1], dtype=np.int64) - np.repeat(total - lens, lens)
    value = BYTE_VALUE[data[within + np.repeat(starts, lens)]]
    value *= table[within]
    return mix(np.add.reduceat(value, total - lens) + lens.astype(np.uint64) * _GOLD)


def word_hashes(column: pa.Array, lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: the first row, the word hashes and the rows' offsets into them."""
    raw, at, _ = texts_of(column)
    for i, j in row_chunks(at):
        data = raw[at[i] : at[j]]
        rows = at[i : j + 1] - at[i]
        starts, ends = word_spans(data, rows)
        if lower:
            data = LOWER[data]
        yield i, span_hashes(data, starts, ends), np.searchsorted(starts, rows)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive words, or of the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for i, salt in enumerate(np.arange(1, k + 1, dtype=np.uint64) * _GOLD):
        out += mix(words[i : n - k + 1 + i] + salt)
    return mix(out + np.uint64(k))
