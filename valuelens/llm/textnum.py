"""NumPy helpers that read a column of texts as one run of UTF-8 bytes.

A task gets Arrow batches; ``chunks`` cuts them into runs of whole texts of a few
megabytes, so memory follows ``CHUNK_BYTES`` (or the longest text), not the batch.
Hashes of words, lines and windows come from one running sum per chunk:
``S[e] - S[s]`` times the inverse power at ``s`` is the polynomial hash of bytes s..e.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64

# The white space of ``[^\x20\x09-\x0D]+`` words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bit mixer for uint64 arrays (a bijection)."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def uniform(h: np.ndarray) -> np.ndarray:
    """Doubles in [0, 1) from uint64 hashes."""
    return (mix(h) >> U64(11)).astype(np.float64) * (1.0 / (1 << 53))


class Chunk:
    """Whole texts as bytes: text i is ``data[off[i]:off[i + 1]]``; ``first`` is the batch row of text 0."""

    def __init__(self, data: np.ndarray, off: np.ndarray, first: int = 0):
        self.data, self.off, self.first, self.n = data, off, first, len(off) - 1
        self._sum = self._inv = None

    def text(self, i: int) -> bytes:
        return self.data[self.off[i]:self.off[i + 1]].tobytes()

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of bytes start..end for each pair; equal strings have equal hashes."""
        if self._sum is None:
            p, self._inv = _grown(len(self.data) + 1)
            self._sum = np.zeros(len(self.data) + 1, U64)
            v = _TABLE[self.data]
            v *= p[:-1]
            np.cumsum(v, out=self._sum[1:])
        h = self._sum[end]
        h -= self._sum[start]
        h *= self._inv[start]
        return mix(h)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and per text the index of its first word (n + 1 values)."""
        inside = ~SPACE[self.data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        edge = self.off[:-1][self.off[:-1] < len(inside)]
        before[edge] = False
        start = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        edge = self.off[1:][self.off[1:] > 0] - 1
        after[edge] = False
        end = np.flatnonzero(inside & ~after) + 1
        return start, end, np.searchsorted(start, self.off)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of ``\\n``-split lines (an empty text has one empty line), and each text's first line."""
        cut = np.flatnonzero(self.data == 10)
        start = np.sort(np.concatenate([self.off[:-1], cut + 1]), kind="stable")
        end = np.sort(np.concatenate([self.off[1:], cut]), kind="stable")
        # a text that ends in a line break has its last, empty line at the next text's start
        count = np.ones(self.n, np.int64) + np.diff(np.searchsorted(cut, self.off))
        first = np.concatenate([[0], np.cumsum(count)])
        return start, end, first


def shingles(word_hash: np.ndarray, first: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words inside each text, and each text's first shingle.

    A text of fewer words (at least one) has one shingle, all its words.
    """
    n = np.diff(first)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    out = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1] - out[:-1], count) + np.arange(out[-1])
    last = np.repeat(first[1:], count)
    h = np.zeros(len(at), U64)
    for j in range(width):
        here = at + j
        ok = here < last
        w = np.where(ok, word_hash[np.minimum(here, max(len(word_hash) - 1, 0))], U64(0)) if len(word_hash) else h
        h = (h ^ w) * U64(0x9FB21C651E98DF25)
        h ^= h >> U64(29)
    return mix(h), out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    column = column.cast(kind) if column.type != kind else column
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1] if off else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), off


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Runs of whole texts with at most ``limit`` bytes each (one text if it alone is longer)."""
    data, off = column_bytes(column)
    row, n = 0, len(off) - 1
    while row < n:
        end = int(np.searchsorted(off, off[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n, row + 20_000)
        yield Chunk(data[off[row]:off[end]], off[row:end + 1] - off[row], row)
        row = end


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices start[0], start[0] + 1, ... (length[0] of them), start[1], ..."""
    total = int(length.sum())
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(total)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for each i, in int64 or float64."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    c = np.concatenate([np.zeros(1, kind), np.cumsum(values, dtype=kind)])
    return c[first[1:]] - c[first[:-1]]
