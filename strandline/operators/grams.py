"""Runs of ``n`` words by number and a row's most frequent words, made in tasks.

Spark hashes each word to 64 bits; numpy makes a number of each run from those of its words, for
all rows of a batch at once, so no text is built for the runs that nobody asks for. Numbers
only choose: what is counted or returned as text is compared as text, and a phrase that is
looked up without its text is told apart by two numbers, 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are worked on at once, bits of a filter at least and at most, bits for each number that it holds alone and before an exact look.
AT_ONCE, LEAST_BITS, MOST_BITS, SPARSE, DENSE = 1 << 20, 15, 29, 64, 16
#: Odd factors of the two numbers of a run.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def hashed(words: Column) -> Column:
    """A number for each word."""
    return F.transform(words, lambda w: F.xxhash64(w))


def _offsets(lists: pa.Array) -> np.ndarray:
    return lists.offsets.to_numpy().astype(np.int64)


def _numbers(words: np.ndarray, n: int, factor: int) -> np.ndarray:
    """The number of the run that begins at each word, runs across lists too."""
    count = max(len(words) - n + 1, 0)
    out = words[:count].copy()
    for j in range(1, n):
        out ^= out >> np.uint64(32)
        out *= np.uint64(factor)
        out += words[j : count + j]
    return out


def _starts(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs inside each list begin, and how many each list has."""
    counts = np.maximum(np.diff(at) - n + 1, 0)
    before = np.cumsum(counts) - counts
    return np.repeat(at[:-1] - before, counts) + np.arange(counts.sum()), counts


def _stretches(at: np.ndarray):
    """Ranges of lists with about ``AT_ONCE`` words, or one list."""
    first = 0
    while first < len(at) - 1:
        last = max(int(np.searchsorted(at, at[first] + AT_ONCE, "right")) - 1, first + 1)
        yield first, last
        first = last


def _runs(lists: pa.Array, n: int, factors: tuple[int, ...]):
    """For each stretch of lists: the first list, where its runs begin, how many each list has, and the runs' numbers."""
    at, values = _offsets(lists), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
    for first, last in _stretches(at):
        own = at[first : last + 1]
        begins, counts = _starts(own - own[0], n)
        words = values[own[0] : own[-1]]
        yield own[0], begins, counts, [_numbers(words, n, f)[begins] for f in factors]


def _listed(counts: list[np.ndarray], values: pa.Array) -> pa.Array:
    sizes = np.concatenate([np.zeros(1, np.int64), *counts])
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), values)


def distinct_runs(words: Column, n: int) -> Column:
    """The numbers of a row's runs, each once, from the numbers of its words."""

    @F.arrow_udf("array<bigint>")
    def made(lists: pa.Array) -> pa.Array:
        sizes, found = [], []
        for _, _, counts, (h,) in _runs(lists, n, FACTORS[:1]):
            ends = np.cumsum(counts)
            first = np.zeros(len(h), bool)
            first[(ends - counts)[counts > 0]] = True
            for a, b in zip(ends - counts, ends):
                h[a:b].sort()
            first[1:] |= h[1:] != h[:-1]
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(first)])
            sizes.append(sums[ends] - sums[ends - counts])
            found.append(h[first].view(np.int64))
        return _listed(sizes, pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))

    return made(words)


def bits_of(numbers: DataFrame, column: str) -> np.ndarray:
    """A filter with a bit set for each number: bytes, a power of two. Tasks fill it in parts of 4 KB, so the driver gets at most 64 MB whatever the rows."""
    wide = min(max(int(SPARSE * max(numbers.count(), 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)
    place = F.col(column).bitwiseAND(F.lit((1 << wide) - 1)) + 1
    parts = numbers.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(1 << (wide - 3), np.uint8)
    for r in parts.toLocalIterator():
        out[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def maybe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the filter has a number's bit."""
    place = h & np.uint64(8 * len(bits) - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def runs_that_may(words: Column, n: int, docs: DataFrame, bits: np.ndarray) -> Column:
    """The texts of a row's runs whose numbers the filter has, as often as they occur; others may be among them."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("array<string>")
    def made(texts: pa.Array, lists: pa.Array) -> pa.Array:
        sizes, places = [], []
        for start, begins, counts, (h,) in _runs(lists, n, FACTORS[:1]):
            good = maybe(sent.value, h)
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(good)])
            ends = np.cumsum(counts)
            sizes.append(sums[ends] - sums[ends - counts])
            places.append(begins[good] + start)
        at = (np.concatenate(places) if places else np.zeros(0, np.int64)) - _offsets(lists)[0] + _offsets(texts)[0]
        parts = [texts.values.take(pa.array(at + j)) for j in range(n)]
        return _listed(sizes, pc.binary_join_element_wise(*parts, " "))

    return made(words, hashed(words))


class Known:
    """Phrases of ``n`` words as two sorted arrays of numbers, sixteen bytes each, and a filter before them."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        order = np.lexsort((second, first))
        self.first, self.second = first[order], second[order]
        same = np.flatnonzero(np.concatenate([[True], self.first[1:] != self.first[:-1]])) if len(order) else np.zeros(0, np.int64)
        self.most = int(np.diff(np.append(same, len(order))).max(initial=0))
        wide = min(max(int(DENSE * max(len(order), 1) - 1).bit_length(), LEAST_BITS), MOST_BITS)
        self.bits = np.zeros(1 << (wide - 3), np.uint8)
        place = self.first & np.uint64((1 << wide) - 1)
        np.bitwise_or.at(self.bits, place >> np.uint64(3), np.left_shift(np.uint8(1), (place & np.uint64(7)).astype(np.uint8)))

    def has(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        some = np.flatnonzero(maybe(self.bits, h))
        at = np.searchsorted(self.first, h[some])
        for j in range(self.most):
            k = np.minimum(at + j, len(self.first) - 1)
            out[some] |= (self.first[k] == h[some]) & (self.second[k] == g[some])
        return out


def known(phrases: DataFrame, column: str, n: int) -> Known:
    """The phrases of ``n`` words; others can't equal a run. Sixteen bytes a phrase come to the driver, so ask for their number before."""

    @F.arrow_udf("array<bigint>")
    def both(lists: pa.Array) -> pa.Array:
        found = [np.stack(h, axis=1) for _, _, _, h in _runs(lists, n, FACTORS)]
        flat = np.concatenate([x.ravel() for x in found]) if found else np.zeros(0, np.uint64)
        return _listed([np.full(len(lists), 2, np.int64)], pa.array(flat.view(np.int64)))

    words = F.split(column, " ", -1)
    rows = phrases.where(F.size(words) == n).select(both(hashed(words)).alias("h")).select(F.get("h", F.lit(0)).alias("a"), F.get("h", F.lit(1)).alias("b"))
    got = rows.toArrow()
    return Known(*(got.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("a", "b")))


def with_known(lists: Column, n: int, docs: DataFrame, phrases: Known) -> Column:
    """For each of a row's lists of word numbers, whether one of its runs is a known phrase."""
    sent = docs.sparkSession.sparkContext.broadcast(phrases)

    @F.arrow_udf("array<boolean>")
    def made(rows: pa.Array) -> pa.Array:
        at = _offsets(rows)
        inner, out = rows.values.slice(at[0], at[-1] - at[0]), []
        for _, _, counts, (h, g) in _runs(inner, n, FACTORS):
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(sent.value.has(h, g))])
            ends = np.cumsum(counts)
            out.append(sums[ends] > sums[ends - counts])
        return _listed([np.diff(at)], pa.array(np.concatenate(out) if out else np.zeros(0, bool)))

    return made(lists)


def most_frequent(words: Column, k: int) -> Column:
    """A row's ``k`` most frequent words as structs ``less, first, term``: minus the count and the place, ties by the first place."""

    @F.arrow_udf("array<struct<less:int,first:int,term:string>>")
    def made(lists: pa.Array) -> pa.Array:
        at, sizes, parts = _offsets(lists), [], []
        for first, last in _stretches(at):
            own = at[first : last + 1]
            told = lists.values.slice(own[0], own[-1] - own[0]).dictionary_encode()
            rows, ids = np.repeat(np.arange(last - first), np.diff(own)), told.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            _, places, counts = np.unique(rows * max(len(told.dictionary), 1) + ids, return_index=True, return_counts=True)
            order = np.lexsort((places, -counts, rows[places]))
            places, counts = places[order], counts[order]
            row = rows[places]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            places, counts, row = places[kept], counts[kept], row[kept]
            sizes.append(np.bincount(row, minlength=last - first))
            columns = [pa.array(-counts, pa.int32()), pa.array(places - (own[row] - own[0]), pa.int32()), told.dictionary.take(pa.array(ids[places]))]
            parts.append(pa.StructArray.from_arrays(columns, ["less", "first", "term"]))
        kind = pa.struct([("less", pa.int32()), ("first", pa.int32()), ("term", pa.string())])
        return _listed(sizes, pa.concat_arrays([x.cast(kind) for x in parts]) if parts else pa.array([], kind))

    return made(words)


def running(numbers: Column) -> Column:
    """Running sums of a row's numbers; a null row stays null."""

    @F.arrow_udf("array<int>")
    def made(lists: pa.Array) -> pa.Array:
        at = _offsets(lists)
        sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(lists.values.to_numpy(zero_copy_only=False).astype(np.int64))])
        own = sums[at[0] + 1 : at[-1] + 1] - np.repeat(sums[at[:-1]], np.diff(at))
        return pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), pa.array(own, pa.int32()), mask=lists.is_null())

    return made(numbers)
