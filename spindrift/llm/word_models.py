"""Class-conditional Kneser-Ney models of words, over what both classes share."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd

from .lookup import Table
from .shingles import word_hashes

#: What each count gives up, and what is added to those of both classes together, for one word never seen too.
DISCOUNT, ADDED = 0.75, 2.0
#: Bytes of a text that are held as arrays at once; words of a window; how many of a text's largest differences count.
PIECE, WINDOW, MOST = 1 << 20, 3, 5
#: Stands before the first word.
START = np.uint64(1)
#: Letters, digits and all characters beyond ASCII make words, A-Z lower-cased; the other bytes part them.
_CLASSES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def hashed_words(text: str | None) -> Iterator[np.ndarray]:
    """The words of a whole text by 64-bit hashes, in pieces of bounded size that end between words."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_CLASSES)
    start = 0
    while start < len(data):
        stop = data.find(b" ", start + PIECE) if start + PIECE < len(data) else -1
        stop = len(data) if stop < 0 else stop
        yield word_hashes(data[start:stop])
        start = stop


def contexts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a word and the one before it, over texts, as signed numbers."""
    first, second = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for text in texts:
        before = START
        for words in hashed_words(text):
            if len(words):
                first.append(np.concatenate([[before], words[:-1]]))
                second.append(words)
                before = words[-1]
    pairs = np.unique(np.stack([np.concatenate(first), np.concatenate(second)], 1).view(np.int64), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _key(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(1)).astype(np.int64)


@dataclass
class WordModels:
    """`table`: of each word the difference of its log-likelihoods, class 1 less class 0; unseen words have that of the shares
    that the classes leave to them."""

    table: Table

    @classmethod
    def fit(cls, counts: pd.DataFrame) -> WordModels:
        """counts: `k` (class, 0 or 1), `w` (a word's hash, as a signed number), `n`: after how many different words of the
        class it stands, which is what Kneser and Ney count.

        P_k(w) = max(n_k(w) - D, 0) / n_k + (D times the words of the class / n_k) P(w), and P(w) is what both classes share:
        (n(w) + ADDED) over the sum of that, a word never seen included. So a rare word that one class has differs little.
        """
        words, at = np.unique(counts["w"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
        n = np.stack([np.bincount(at, counts["n"].to_numpy(float) * (counts["k"].to_numpy() == k), len(words)) for k in (0, 1)], 1)
        both, held = n.sum(1), n.sum(0)
        shared = (both + ADDED) / (both.sum() + ADDED * (len(words) + 1))
        with np.errstate(invalid="ignore", divide="ignore"):
            left = np.where(held > 0, DISCOUNT * (n > 0).sum(0) / held, 1.0)
            own = np.where(held > 0, np.maximum(n - DISCOUNT, 0) / held, 0.0)
        p = own + left * shared[:, None]
        unseen = float(np.log(left[1] / left[0]))
        return cls(Table.build(_key(words), np.log(p[:, 1] / p[:, 0])[:, None], [unseen]))

    def differences(self, text: str | None) -> Iterator[np.ndarray]:
        for words in hashed_words(text):
            if len(words):
                yield self.table.values[self.table.find(_key(words)), 0].astype(float)

    def features(self, text: str | None) -> list[float]:
        """The mean difference a word, the largest ones' means (1, 3 and MOST of them, fewer in shorter texts), the largest
        sum of WINDOW words in a row (fewer at a text's ends) and the logarithm of the number of words; 0 without words."""
        total, n, top, window, tail = 0.0, 0, np.zeros(0), -np.inf, np.zeros(0)
        for d in self.differences(text):
            total, n = total + float(d.sum()), n + len(d)
            both = np.concatenate([top, d])
            top = np.sort(np.partition(both, -MOST)[-MOST:] if len(both) > MOST else both)
            both = np.concatenate([tail, d])
            window, tail = max(window, float(np.convolve(both, np.ones(WINDOW)).max())), both[-(WINDOW - 1) :]
        return [total / n, float(top[-1]), float(top[-3:].mean()), float(top.mean()), window, float(np.log1p(n))] if n else [0.0] * 6
