"""Content-anchored sample positions of byte strings.

Position p is an anchor if the hash of the GRAM bytes at p is the least of some WINDOW
consecutive positions. GRAM + WINDOW - 1 = 200: every 200-byte string holds an anchor with its
whole gram, and which positions of it are the least depends on these 200 bytes alone. So equal
200-byte strings have equal anchors at equal places, and only suffixes that begin at anchors need
to be indexed.
"""

from __future__ import annotations

import numpy as np

from .common import BYTE_VALUES, RangeHash, mix

LENGTH = 200
GRAM = 48
WINDOW = LENGTH - GRAM + 1


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width values."""
    out, done = x, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def anchors(hasher: RangeHash, first: int, end: int) -> np.ndarray:
    """Anchors of the string at [first, end) of hashed data; none if it is shorter than LENGTH."""
    n = end - first - GRAM + 1
    if end - first < LENGTH:
        return np.empty(0, np.int64)
    at = np.arange(first, first + n)
    h = hasher.of(at, at + GRAM)
    low = sliding_min(h, WINDOW)  # of positions j .. j + WINDOW - 1
    pad = np.zeros(WINDOW - 1, np.uint64)
    most = ~sliding_min(~np.concatenate([pad, low, pad]), WINDOW)  # greatest low of the runs that hold a position
    return at[h == most]
