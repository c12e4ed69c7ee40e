"""Words of whole columns of text as byte ranges."""

from __future__ import annotations

import numpy as np


def table(separators: bytes) -> np.ndarray:
    """Byte to byte: A-Z as a-z, `separators` as 0.  All of them are ASCII, so UTF-8 stays whole."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[list(separators)] = 0
    return out


def ranges(lowered: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-zero bytes, cut at `offsets`, and how many each text has."""
    inside = lowered != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(inside)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:][offsets[1:] > 0] - 1
    last[cuts] = inside[cuts]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))
