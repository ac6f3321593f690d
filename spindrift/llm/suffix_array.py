"""Suffix arrays and common prefixes in numpy, to the depth that a window needs."""

from __future__ import annotations

import numpy as np

#: Positions that one lane of the common-prefix computation goes through in turn.
LANE = 256


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number in the order of bytes; zeros after the end."""
    k = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for size in (1, 2, 4):
        k[:-size] = (k[:-size] << np.uint64(8 * size)) | k[size:]
    return k


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes' first `depth` bytes at least.

    Larsson-Sadakane refinement: suffixes start in groups by eight bytes; each round sorts only the groups of two and
    more, by the group of the suffix as many bytes further as are sorted already, which doubles that depth.
    """
    n = len(data)
    key = _eight(data)[:n]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    head = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]) if n else np.zeros(0, bool)
    slots = np.arange(n)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(head, slots, 0))
    done = 8
    open_ = slots[~(head & np.append(head[1:], True))]
    while done < depth and len(open_):
        at = order[open_]
        pair = rank[at] * (n + 1) + rank[np.minimum(at + done, n)] + 1
        by = np.argsort(pair, kind="stable")
        at, pair = at[by], pair[by]
        order[open_] = at
        head = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[at] = np.maximum.accumulate(np.where(head, open_, 0))
        open_ = open_[~(head & np.append(head[1:], True))]
        done *= 2
    return order


def shares_with_previous(data: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """For each place in the suffix array, whether its suffix shares `least` bytes or more with the one before.

    Kasai's recurrence: a position shares at least one byte less than the position before it. It holds up to the depth
    to which the suffixes are sorted; a position after one that shares so much starts anew. Lanes of positions go through
    it side by side, eight bytes a step.
    """
    depth = 8
    while depth < least:
        depth *= 2
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    key = _eight(data)
    lanes = np.arange(0, n, LANE)
    length = np.zeros(len(lanes), np.int64)
    share = np.zeros(n, bool)
    for r in range(min(LANE, n)):
        at = lanes + r
        alive = at < n
        i = at[alive]
        j = before[i]
        l = np.where(length[alive] < depth, np.maximum(length[alive] - 1, 0), 0)
        l[j < 0] = 0
        room = np.where(j < 0, 0, n - np.maximum(i, j))
        go = np.flatnonzero((l < depth) & (l < room))
        while len(go):
            differ = key[i[go] + l[go]] ^ key[j[go] + l[go]]
            # whole bytes before the first that differs
            same = np.sum([differ < np.uint64(1 << (64 - 8 * k)) for k in range(1, 8)], axis=0) + (differ == 0)
            l[go] = np.minimum(l[go] + same, room[go])
            go = go[(same == 8) & (l[go] < depth) & (l[go] < room[go])]
        length[alive] = l
        share[i] = l >= least
    return share[order]
