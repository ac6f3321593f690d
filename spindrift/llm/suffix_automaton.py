"""Generalised suffix automata of sequences of numbers, to a bounded depth, in numpy.

The states of a suffix automaton are the classes of substrings that end at the same places, and its suffix links form the
suffix tree of the reversed sequences. Substrings of up to `depth` symbols need that tree to that depth only, so it is
made by sorting the places by what ends there, read backwards, instead of adding one symbol after the other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bits of a symbol; three of them fill a key.
BITS = 21
MOST_SYMBOLS = (1 << BITS) - 2


@dataclass
class Automaton:
    """States in order; state 0 is the root, whose substring is the empty one.

    A state stands for the substrings that end at `end` (one of its places) and have over `length[link]` and up to `length`
    symbols: all of them end at the same `count` places.
    """

    length: np.ndarray
    link: np.ndarray
    count: np.ndarray
    end: np.ndarray

    def substrings(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of all distinct substrings of `size` symbols: a place where each ends, and at how many it does."""
        has = np.flatnonzero((self.length >= size) & (self.length[self.link] < size))
        has = has[has > 0]
        return self.end[has], self.count[has]


def suffix_automaton(symbols: np.ndarray, depth: int, skip: int = 0) -> Automaton:
    """symbols: numbers from 0 to MOST_SYMBOLS - 1, and -1 between sequences, over which no substring reaches. depth: 1 to 3.
    The first `skip` places are only what stands before the others; what ends at them isn't counted."""
    n = len(symbols)
    wide = np.concatenate([np.full(depth, -1, np.int64), symbols.astype(np.int64)]) + 1
    back = [wide[depth - k : depth - k + n] for k in range(depth)]  # the symbol at a place, the one before it, ...
    for k in range(1, depth):
        back[k] = np.where(back[k - 1] == 0, 0, back[k])  # nothing reaches over a gap
    places = skip + np.flatnonzero(back[0][skip:])
    key = np.zeros(len(places), np.int64)
    for k in range(depth):
        key = key << BITS | back[k][places]
    order = np.argsort(key, kind="stable")
    key, places = key[order], places[order]
    # nodes of the reversed tree: runs of equal keys to 1, 2, ... symbols
    length, link, count, end = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.array([len(places)])], [np.array([-1])]
    made, state = 1, np.zeros(len(places), np.int64)  # the state of each place's substring at the level above
    counts = np.full(len(places), len(places))
    for k in range(1, depth + 1):
        part = key >> BITS * (depth - k)
        real = (part & ((1 << BITS) - 1)) != 0
        head = real.copy()
        head[1:] &= part[1:] != part[:-1]
        starts = np.flatnonzero(head)
        if not len(starts):
            break
        run = np.cumsum(head) - 1
        sizes = np.bincount(run[real], minlength=len(starts))
        # a substring that ends wherever its suffix does is in the suffix's state, which becomes longer
        same = (sizes == counts[starts]) & (state[starts] > 0)
        grown = np.concatenate(length)
        grown[state[starts[same]]] = k
        own = np.where(same, state[starts], 0)
        own[~same] = made + np.arange(int((~same).sum()))
        length, new = [grown, np.full(int((~same).sum()), k)], starts[~same]
        link.append(state[new])
        count.append(sizes[~same])
        end.append(places[new])
        made += len(new)
        state = np.where(real, own[run], -1)
        counts = np.where(real, sizes[run], -1)
    return Automaton(np.concatenate(length), np.concatenate(link), np.concatenate(count), np.concatenate(end))
