"""Words of UTF-8 texts as numpy arrays: no Python object is made per word.

A batch of texts is one ``uint8`` buffer and row offsets. Word hashes are
polynomial sums over random byte codes modulo 2**64, taken for a block of words at
once from one running sum, then mixed. They don't depend on where a word stands, so
a very long text takes a few numbers for each word and not for each byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLANKS = np.zeros(256, bool)
BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}
#: Bytes whose running sum is taken at a time (one word at least).
BLOCK = 1 << 20


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, BLOCK + 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``most`` bytes; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, raw[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes that aren't ``blank``, and the number in each row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    inside = ~blank[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def hashes(data: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> np.ndarray | list[np.ndarray]:
    """A 64-bit hash of each span of bytes; it depends on the bytes alone. One array for each array of ends."""
    out = [np.empty(len(starts), np.uint64) for _ in ends]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK)))
        low, n = starts[i], int(max(end[i:j].max() for end in ends) - starts[i])
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[data[low : low + n]] * _power(_INVERSE, n), out=total[1:])
        power = _power(_BASE, n + 1)
        for found, end in zip(out, ends):
            a, b = starts[i:j] - low, end[i:j] - low
            found[i:j] = mix((total[b] - total[a]) * power[b] + (b - a).astype(np.uint64))
        i = j
    return out[0] if len(out) == 1 else out


def row_ids(counts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(counts)), counts)


def lower_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes (A-Z only), starts, ends, count by row and hash of each word."""
    data = LOWER[data]
    starts, ends, counts = spans(data, offsets)
    return data, starts, ends, counts, hashes(data, starts, ends)


class Lookup:
    """Places of 64-bit keys in an array of distinct keys, by a hash table with linear probing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.keys = np.concatenate([keys, np.zeros(1, np.uint64)])  # place -1 reads the last
        todo, at, self.probes = np.arange(len(keys), dtype=np.int32), self._slot(keys), 0
        while len(todo):
            self.probes += 1
            free = self.table[at] < 0
            self.table[at[free]] = todo[free]
            late = self.table[at] != todo
            todo, at = todo[late], (at[late] + 1) & (len(self.table) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for one that isn't there."""
        at = self._slot(keys)
        place = self.table[at]
        out = np.where((place >= 0) & (self.keys[place] == keys), place, -1)
        open_ = np.flatnonzero((place >= 0) & (out < 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.table) - 1)
            place = self.table[at[open_]]
            hit = (place >= 0) & (self.keys[place] == keys[open_])
            out[open_[hit]] = place[hit]
            open_ = open_[(place >= 0) & ~hit]
        return out
