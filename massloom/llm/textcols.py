"""Vectorised words and hashes of Arrow text columns."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACES = b" \t\n\x0b\x0c\r"
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_ROLL = 0xD1342543DE82EF95 | 1
_ROLL_INV = pow(_ROLL, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits each depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D))
_LOWER_CODES = _CODES.copy()
_LOWER_CODES[65:91] = _CODES[97:123]
SPACE = np.zeros(256, bool)
SPACE[list(_SPACES)] = True
#: ASCII other than letters and digits.
PUNCTUATION = np.array([k < 128 and not chr(k).isalnum() for k in range(256)])

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept between calls up to a few MB."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, U64(base), U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the bounds of its rows (n + 1 of them); null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    _, offsets, data = col.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    lo, hi = int(bounds[0]), int(bounds[-1])
    buf = np.frombuffer(data, np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
    return buf, bounds - lo


def _trim() -> None:
    """Give freed memory back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text; a longer text is a batch by itself."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = utf8(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    _trim()


class Words:
    """Maximal runs of bytes that are not gaps (ASCII white space), of all rows of a batch.

    start, end: byte bounds of each word; rows: word bounds of each row (n + 1).
    """

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, gaps: np.ndarray = SPACE):
        self.buf, self.bounds, self._total = buf, bounds, None
        n = len(buf)
        if n:
            solid = ~gaps[buf]
            fresh = np.zeros(n + 1, bool)  # a row starts here
            fresh[bounds] = True
            before = np.empty(n, bool)
            before[0] = True
            np.logical_not(solid[:-1], out=before[1:])
            after = np.empty(n, bool)
            after[-1] = True
            np.logical_not(solid[1:], out=after[:-1])
            self.start = np.flatnonzero(solid & (before | fresh[:n]))
            self.end = np.flatnonzero(solid & (after | fresh[1:])) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.rows = np.searchsorted(self.start, bounds)

    def _sums(self, lower: bool) -> np.ndarray:
        if self._total is None or self._total[0] != lower:
            codes = (_LOWER_CODES if lower else _CODES)[self.buf]
            codes *= powers(_BASE, len(codes))
            total = np.zeros(len(codes) + 1, U64)
            np.cumsum(codes, out=total[1:])
            self._total = lower, total
        return self._total[1]

    def hashes(self, lower: bool = False) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U64)
        total = self._sums(lower)
        return mix((total[self.end] - total[self.start]) * powers(_BASE_INV, len(self.buf))[self.start])

    def beginnings(self, n: int, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """A hash of the first n bytes of each word that has more, and which words those are."""
        of = np.flatnonzero(self.end - self.start > n)
        if not len(of):
            return np.zeros(0, U64), of
        total, start = self._sums(lower), self.start[of]
        return mix((total[start + n] - total[start]) * powers(_BASE_INV, len(self.buf))[start]), of

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def ngrams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every run of n words that lies in one row, and the bounds of the rows (shorter rows: none)."""
    per_row = np.maximum(np.diff(rows) - n + 1, 0)
    bounds = np.concatenate(([0], np.cumsum(per_row)))
    if not bounds[-1]:
        return np.zeros(0, U64), bounds
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * powers(_ROLL, len(hashes)), out=total[1:])
    first = np.arange(bounds[-1]) + np.repeat(rows[:-1] - bounds[:-1], per_row)
    return mix((total[first + n] - total[first]) * powers(_ROLL_INV, len(hashes))[first]), bounds

