"""Word shingles of whole texts as 64-bit hashes, many texts at a time, in numpy.

A word is a run of ASCII letters and digits and of characters beyond ASCII, in lower case; all
else parts words. A text of fewer words than a shingle, but of one at least, is one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import BYTE_VALUES, RangeHash, mix

WORDS = 5
#: Bytes of text that are hashed at one time, unless one text is larger.
CHUNK = 1 << 22
_IN_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, end, lower-case bytes) of runs of texts with about CHUNK bytes; null counts as empty."""
    first, size, held = 0, 0, []
    for i, t in enumerate(texts):
        held.append((t or "").lower().encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= CHUNK:
            yield first, i + 1, held
            first, size, held = i + 1, 0, []
    if held:
        yield first, len(texts), held


def word_hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every text and the end)."""
    data = np.frombuffer(b" ".join(blobs) + b" ", np.uint8)
    inside = _IN_WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.cumsum([len(b) + 1 for b in blobs])
    firsts = np.concatenate([[0], np.searchsorted(start, ends)])
    return (RangeHash(BYTE_VALUES[data]).of(start, end) if len(start) else np.empty(0, np.uint64)), firsts


def shingle_sequence(words: np.ndarray, width: int = WORDS) -> np.ndarray:
    """The hash of every shingle of one text's words, in order, repeats included."""
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        if len(words) < width:
            out = np.full(1, len(words), np.uint64)
            for w in words:
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w)
            return out
        out = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)]
        return mix(out)


def shingle_sets(texts: list[str | None], width: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for _, _, blobs in chunks(texts):
        words, firsts = word_hashes(blobs)
        for a, b in zip(firsts[:-1], firsts[1:], strict=True):
            yield np.unique(shingle_sequence(words[a:b], width))


_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """MinHash signatures (rows of uint32) of non-empty sets."""
    out = np.empty((len(sets), size), np.uint32)
    if not len(sets):
        return out
    all_ = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    with np.errstate(over="ignore"):
        for i in range(size):
            out[:, i] = np.minimum.reduceat(all_ * _MULTIPLIERS[i], starts) >> np.uint64(32)
    return out
