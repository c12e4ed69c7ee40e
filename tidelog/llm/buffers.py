"""Whole Arrow columns of text as NumPy buffers, and hashes of their byte ranges.

The kernels of this subpackage work on the UTF-8 bytes of many documents at once.  `slices`
bounds how many bytes are looked at together; a document longer than that is a slice alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel looks at together.
SLICE_BYTES = 1 << 20

#: Odd, so that it has an inverse modulo 2**64; hashes are taken modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """`column` as (offsets, bytes); a null is an empty text."""
    whole = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = whole.buffers()
    at = np.frombuffer(offsets, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return at, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The byte ranges between `offsets` as a binary column."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of documents that have at most `size` bytes together, or one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (in place)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n, SLICE_BYTES) + 1, base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * SLICE_BYTES:  # a table for one very long text is not kept
            _powers[base] = have
    return have[: n + 1]


class RangeHash:
    """Hashes of byte ranges [start, end) of `data`; equal bytes have equal hashes anywhere."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[data] * _power(_BASE, n)[:n], out=self._sums[1:])
        self._back = _power(_INVERSE, n)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sums[end] - self._sums[start]) * self._back[start])

    def windows(self, width: int) -> np.ndarray:
        """The hash of every window of `width` bytes."""
        n = len(self._sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self._sums[width:] - self._sums[:n]) * self._back[:n])
