"""Rows of numbers by key, found for many keys at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Table:
    """Rows of values by key; row len(keys) - 1 is that of unseen keys. A key stands in the first free slot from its own on."""

    keys: np.ndarray
    values: np.ndarray
    slots: np.ndarray

    @staticmethod
    def slot(keys: np.ndarray, size: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray, unseen: list[float]) -> Table:
        """keys: distinct, not negative."""
        size = 1 << max(4, int(4 * max(len(keys), 1)).bit_length())
        slots = np.full(size, len(keys), np.int32)
        left, at = np.arange(len(keys)), cls.slot(keys, size)
        while len(left):
            free = slots[at] == len(keys)
            slots[at[free]] = left[free]
            out = slots[at] != left
            left, at = left[out], (at[out] + 1) & (size - 1)
        return cls(np.append(keys, -1), np.concatenate([values, [unseen]]).astype(np.float32), slots)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key."""
        at = self.slot(keys, len(self.slots))
        found = self.slots[at]
        last = len(self.keys) - 1
        other = np.flatnonzero((self.keys[found] != keys) & (found != last))
        while len(other):
            at[other] = (at[other] + 1) & (len(self.slots) - 1)
            found[other] = self.slots[at[other]]
            other = other[(self.keys[found[other]] != keys[other]) & (found[other] != last)]
        return found.astype(np.int64)
