"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a unit vector by ``hashes`` random projections cut into steps of
``width``. A query visits its own bucket in each table and then the buckets around
it: a change of some of the projections by one step each, in the order of their
estimated chance of success (the expected squared distances to the nearest
borders, by rank, fix one sequence of changes; each query maps the ranks to its
own projections). Rows met in any table are reranked by exact cosine. A query
that met fewer rows than wanted looks at all rows of the block.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best


@dataclass(frozen=True)
class Hashing:
    tables: int = 16
    hashes: int = 10
    width: float = 2.0
    probes: int = 200
    seed: int = 8


def probe_sequence(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of ranks to change, by rising expected score; the empty set (the own bucket) first.

    Ranks 0 .. 2 * hashes - 1 order the distances to the borders; rank j and its mirror belong to the two borders of one
    projection, so no set has both.
    """
    m = hashes
    cost = [(j + 1) * (j + 2) / (4 * (m + 1) * (m + 2)) for j in range(m)]
    cost += [1 - (m - j) / (m + 1) + (m - j) * (m - j + 1) / (4 * (m + 1) * (m + 2)) for j in range(m)]
    out: list[tuple[int, ...]] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        _, s = heapq.heappop(heap)
        if all(2 * m - 1 - j not in s for j in s):
            out.append(s)
        last = s[-1]
        if last + 1 < 2 * m:
            for new in ((*s[:-1], last + 1), (*s, last + 1)):
                heapq.heappush(heap, (sum(cost[j] for j in new), new))
    return out


def tables(how: Hashing):
    """Makes the index of a block."""
    sequence = probe_sequence(how.hashes, how.probes)
    picks = np.zeros((len(sequence), 2 * how.hashes))
    for i, s in enumerate(sequence):
        picks[i, list(s)] = 1

    def build(matrix: np.ndarray):
        n, dim = matrix.shape
        r = np.random.default_rng([how.seed, dim])
        lines = r.normal(size=(how.tables, dim, how.hashes))
        shifts = r.uniform(0, how.width, (how.tables, how.hashes))
        odd = r.integers(1, 2**62, (how.tables, how.hashes)) * 2 + 1
        unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
        stored = []
        with np.errstate(over="ignore"):
            for t in range(how.tables):
                keys = (np.floor((unit @ lines[t] + shifts[t]) / how.width).astype(np.int64) * odd[t]).sum(1)
                order = np.argsort(keys, kind="stable")
                stored.append((keys[order], order))

        def search(queries: np.ndarray, want: int) -> list[np.ndarray]:
            asked = queries / np.linalg.norm(queries, axis=1, keepdims=True)
            met = np.zeros((len(asked), n), bool)
            with np.errstate(over="ignore"):
                for t, (keys, order) in enumerate(stored):
                    at = (asked @ lines[t] + shifts[t]) / how.width
                    cell = np.floor(at)
                    low = at - cell
                    near = np.argsort(np.concatenate([low, 1 - low], 1), axis=1, kind="stable")  # rank -> border
                    change = np.concatenate([-odd[t], odd[t]])[near]
                    probe = (cell.astype(np.int64) * odd[t]).sum(1)[:, None] + change @ picks.T.astype(np.int64)
                    first, last = np.searchsorted(keys, probe.ravel(), "left"), np.searchsorted(keys, probe.ravel(), "right")
                    size = last - first
                    ends = np.cumsum(size)
                    place = order[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
                    met[np.repeat(np.repeat(np.arange(len(asked)), probe.shape[1]), size), place] = True
            return [np.flatnonzero(m) if m.sum() >= min(want, n) else np.arange(n) for m in met]

        return search

    return build


def cosines(q: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return (matrix * q).sum(1) / (np.sqrt((matrix * matrix).sum(1)) * np.sqrt((q * q).sum()))


def neighbours(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, how: Hashing = Hashing(), **more) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found, by cosine, ties to the smaller id.

    Vectors that are null, zero, empty or hold a null or non-finite component take no part. Rows with equal vectors have
    equal scores. An empty table gives an empty one. Every row is indexed.
    """
    full = lambda df: df.where(F.exists("vec", lambda x: x != 0))
    return best(rows, key=key, vector=vector, every=every, k=k, index=tables(how), prepare=full, of=cosines, **more)
