"""Whole-text tokenising and hashing on Arrow string buffers with numpy.

A batch of texts is one UTF-8 byte array plus row offsets; words, hashes and per-row counts are
computed for all rows at once, so no Python string is made per word. Words are maximal runs of
``[^\\x20\\x09-\\x0D]`` and never cross a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least n of each."""
    for k, base in enumerate((_BASE, _INV)):
        p = _powers[k]
        while len(p) < n:
            p = np.concatenate([p, p * (p[-1:] * base)])
        _powers[k] = p
    return _powers[0], _powers[1]


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then from start[1], and so on."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


@dataclass
class Chunk:
    """Rows ``rows`` of a batch: their bytes, and the offsets of each row within them."""

    rows: slice
    data: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a value per byte, by row."""
        c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return c[self.off[1:]] - c[self.off[:-1]]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Slices of an Arrow string array of about ``limit`` bytes; nulls count as empty. A longer text is a chunk of its own."""
    a = texts.cast(pa.large_string()).fill_null("") if len(texts) else texts.cast(pa.large_string())
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    if not len(a):
        return
    _, offsets, body = a.buffers()
    off = np.frombuffer(offsets, np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        end = min(end, len(a))
        yield Chunk(slice(at, end), data[off[at] : off[end]], off[at : end + 1] - off[at])
        at = end


@dataclass
class Words:
    """Word spans in bytes, the row of each, and where each row's words start."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # len(rows) + 1

    def __len__(self) -> int:
        return len(self.start)

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.first)


def words(c: Chunk, space: np.ndarray = SPACE) -> Words:
    n = len(c.data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~space[c.data]
    first = np.zeros(n + 2, bool)
    first[c.off + 1] = True  # a row's first byte starts a word even after a row without trailing space
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | first[1:])[: n + 1])
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | first[1:]))
    begin = np.searchsorted(start, c.off)
    row = np.repeat(np.arange(len(c)), np.diff(begin))
    return Words(start, end, row, begin)


def hash_words(data: np.ndarray, w: Words, keep: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the words' bytes; with ``keep``, of the bytes flagged only (0 where a word has none)."""
    if not len(w):
        return np.zeros(0, np.uint64)
    at = np.arange(len(data)) if keep is None else np.cumsum(keep) - keep
    pw, inv = powers(len(data) + 1)
    value = (data.astype(np.uint64) + np.uint64(1)) * pw[at]
    if keep is not None:
        value *= keep
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    raw = (total[w.end] - total[w.start]) * inv[at[w.start]]
    return np.where(raw == 0, np.uint64(0), mix(raw))


def windows(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one row, and the index of each one's first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(m, np.uint64)
    for k in range(n):
        acc = acc * _BASE + mix(h[k : k + m] + np.uint64(k + 1))
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    return mix(acc[at]), at
