"""Hashes of words and of word n-grams, in numpy."""

from __future__ import annotations

import numpy as np

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each run of bytes without white space, in order."""
    codes = np.frombuffer(data, np.uint8)
    solid = ~_BLANK[codes]
    start = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]]))
    if not len(start):
        return np.zeros(0, np.uint64)
    codes, solid, start = codes[start[0] :], solid[start[0] :], start - start[0]
    place = np.arange(len(codes), dtype=np.uint64) - np.repeat(start, np.diff(np.append(start, len(codes)))).astype(np.uint64)
    h = (codes.astype(np.uint64) + np.uint64(1)) * (_A + place * _B)
    h ^= h >> np.uint64(31)
    h *= _B
    h[~solid] = 0
    return _mix(np.add.reduceat(h, start))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of a text's n-word shingles, A-Z lower-cased; with fewer words, of all of them as
    one; empty for a text without words."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(words):
        return words
    k = min(n, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h = _mix(h * _A + words[i : len(words) - k + 1 + i])
    return np.unique(h)
