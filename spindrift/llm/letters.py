"""Texts as arrays of letters, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Code points of a text that are held as arrays at once.
PIECE = 1 << 20
BLANK = 32


@lru_cache(1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_pieces(text: str | None, overlap: int) -> Iterator[np.ndarray]:
    """The lower-cased code points of the whole text, in pieces; each run of anything but letters is one blank, and a
    blank stands at either end. Each piece begins with the last `overlap` codes of the one before."""
    text = text or ""
    tail, after_letter = np.zeros(0, np.uint32), True
    for i in range(0, max(len(text), 1), PIECE):
        raw = " " * (i == 0) + text[i : i + PIECE].lower() + " " * (i + PIECE >= len(text))
        codes = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _is_letter()[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first of a run that isn't letters
        keep[0] |= after_letter
        after_letter = bool(letter[-1])
        codes = np.concatenate([tail, np.where(letter, codes, BLANK)[keep].astype(np.uint32)])
        yield codes
        tail = codes[-overlap:] if overlap else tail
