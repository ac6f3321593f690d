"""Content anchors: of every window of bytes, the place of its smallest hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that a hash covers; a power of two.
GRAM = 32
#: Window starts that are held as arrays at once; places in them fit the low bits of a key.
PIECE, PLACE_BITS = 1 << 22, 24
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_LOW = np.uint64((1 << PLACE_BITS) - 1)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def anchors(data: bytes, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each anchor of data: its hash, and the first and last start of the windows it stands for.

    Equal windows have equal anchors, wherever they are. A window's anchor is the leftmost smallest hash of the grams
    inside it, so the windows of one anchor are neighbours. Data shorter than a window has none.
    """
    for begin in range(0, max(len(data) - window + 1, 0), PIECE):
        h = _TABLE[np.frombuffer(data, np.uint8, min(PIECE + window - 1, len(data) - begin), begin)]
        step = 1
        for odd in _ODD:
            h = h[:-step] * odd + h[step:]
            step *= 2
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        at = (_sliding_min((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), window - GRAM + 1) & _LOW).astype(np.int64)
        low = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        high = np.append(low[1:] - 1, len(at) - 1)
        yield h[at[low]].view(np.int64), low + begin, high + begin
