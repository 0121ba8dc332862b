"""Vectorised text kernels for Arrow batches, shared by the operators of this package.

Everything works on whole texts. A batch is cut into runs of rows of about
``CHUNK_BYTES``, so that the memory of a task follows the longest text, not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_U = np.uint64
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_WIDTH_CODES = mix64(np.arange(1001, 1065, dtype=np.uint64) * _U(_BASE)) | _U(1)


class _Powers:
    """Powers of an odd base modulo 2**64, grown to the longest run met so far."""

    def __init__(self, base: int):
        self.base = _U(base)
        self.known = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            steps = np.full(n + n // 4, self.base, dtype=np.uint64)
            steps[0] = 1
            self.known = np.cumprod(steps, dtype=np.uint64)
        return self.known[:n]


_POWERS, _INVERSES = _Powers(_BASE), _Powers(_INVERSE)


def text_runs(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows as (first row, row after the last, UTF-8 bytes, offsets of the rows).

    A null counts as the empty text.
    """
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    size = int(offsets[-1])
    data = np.frombuffer(buffers[2], dtype=np.uint8, count=size) if size else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs outside U+0020 and U+0009 to U+000D), and words per row."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets) - 1, dtype=np.int64)
    inside = ~_SEPARATOR[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    codes = _CODES[_LOWER[data] if lower else data]
    codes *= _POWERS.upto(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(codes, out=total[1:])
    hashes = (total[ends] - total[starts]) * _INVERSES.upto(n)[starts]
    hashes = mix64(hashes + (ends - starts).astype(np.uint64) * _U(_BASE))
    at = np.searchsorted(starts, offsets)
    return hashes, np.diff(at)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-word windows, row by row, and their number per row.

    A row of fewer words has one window, its whole sequence; a row without words none.
    """
    n = len(words)
    acc = words * _WIDTH_CODES[0]
    for j in range(1, width):
        if n > j:
            acc[: n - j] += words[j:] * _WIDTH_CODES[j]
    ends = np.cumsum(counts)
    starts = ends - counts
    keep = np.ones(n, dtype=bool)
    for j in range(1, width):  # windows that would leave their row
        last = ends - j
        keep[last[(counts >= width) & (last >= starts)]] = False
    short = np.flatnonzero((counts > 0) & (counts < width))
    for row in short:
        a, b = starts[row], ends[row]
        keep[a:b] = False
        keep[a] = True
        ordered = words[a:b] * _WIDTH_CODES[: b - a]
        acc[a] = ordered.sum(dtype=np.uint64) ^ _WIDTH_CODES[63 - (b - a)]
    sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    return mix64(acc[keep]), sizes


def list_array(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow list column from flat values and the length of each row."""
    ends = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, type=kind))
