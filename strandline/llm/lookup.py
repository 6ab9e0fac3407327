"""A hash table of whole numbers as numpy arrays, asked for many keys at once."""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int32).max


class Lookup:
    """Keys (int64, not negative, each once) to values (int32 below ``NONE``), open addressing with linear probes."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        at, self.probes = self._slot(keys), 0
        while len(keys):  # of the keys that want a free slot one gets it, the rest look at the next slot
            self.probes += 1
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            own = self.keys[at] == keys
            self.values[at[own]] = values[own]
            keys, values, at = keys[~own], values[~own], (at[~own] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or ``NONE``."""
        at = self._slot(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.values[at], NONE)
        open_ = np.flatnonzero((got != keys) & (got != -1))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at_open = (at.flat[open_] + 1) & (len(self.keys) - 1)
            at.flat[open_] = at_open
            got = self.keys[at_open]
            hit = got == keys.flat[open_]
            out.flat[open_[hit]] = self.values[at_open[hit]]
            open_ = open_[~hit & (got != -1)]
        return out
