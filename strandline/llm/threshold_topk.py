"""Exact top-k inner products by Fagin's threshold algorithm.

Each block keeps one list of its rows per dimension, in order of the component.
A query walks all lists from the end that helps it most, in growing steps; rows
met for the first time are scored in full. The best score that an unmet row can
have is the sum of what the lists show at the present depth. Once the k-th score
is above that bound no unmet row can be among the best, ties included.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import best

STEP = 16


def lists(matrix: np.ndarray):
    """A search over the rows of ``matrix``."""
    order = np.argsort(matrix, axis=0, kind="stable")
    values = np.take_along_axis(matrix, order, 0)
    n = len(matrix)

    def search(queries: np.ndarray, want: int) -> list[np.ndarray]:
        return [visit(q, want) for q in queries]

    def visit(q: np.ndarray, want: int) -> np.ndarray:
        used = np.flatnonzero(q)
        if not len(used):
            return np.arange(n)
        down = q[used] > 0
        seen = np.zeros(n, bool)
        rows, scores = [], np.zeros(0)
        depth, step = 0, STEP
        while depth < n:
            end = min(n, depth + step)
            met = np.concatenate([order[n - end : n - depth, used[down]].ravel(), order[depth:end, used[~down]].ravel()])
            fresh = np.zeros(n, bool)
            fresh[met] = True
            new = np.flatnonzero(fresh & ~seen)
            seen |= fresh
            rows.append(new)
            scores = np.concatenate([scores, matrix[new] @ q])
            bound = values[n - end, used[down]] @ q[used[down]] + values[end - 1, used[~down]] @ q[used[~down]]
            if len(scores) >= want and np.partition(scores, len(scores) - want)[len(scores) - want] > bound:
                break
            if seen.all():
                break
            depth, step = end, step * 2
        return np.concatenate(rows)

    return search


def products(q: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return np.rint(matrix @ q).astype(np.int64)


def top_products(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, scale: int = 1024, **more) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest inner products of vectors turned into floor(scale * component).

    Ties go to the smaller id. Rows that are null, or whose vector is null, empty or holds a null or non-finite component,
    take no part. Products are whole numbers, exact while they stay below 2 ** 53. An empty table gives an empty one.
    """
    whole = lambda df: df.select("id", F.transform("vec", lambda x: F.floor(x * scale).cast("double") + 0.0).alias("vec"))
    return best(rows, key=key, vector=vector, every=every, k=k, index=lists, prepare=whole, score_type="long", of=products, **more)
