"""What both vector searches share: a stated query set against all rows, in blocks.

Rows with equal vectors form a class that keeps the few smallest ids that a
result can need, so a very common vector is one row. Classes are dealt into
blocks of bounded size. Queries come to the driver in chunks of bounded size;
each chunk is searched in every block, and the best rows of all blocks are
merged. So neither side is ever whole in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shelf import Shelf, lean

#: Rows of a block and queries of a chunk.
BLOCK = 8192
CHUNK = 4096


def usable(rows: DataFrame, *, key: str, vector: str) -> DataFrame:
    """``id, vec`` (double) of the rows that take part: an id, and a vector of finite components."""
    v = F.col("vec")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return rows.select(rows[key].cast("long").alias("id"), rows[vector].cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite))


def classes(found: DataFrame, least: int) -> DataFrame:
    """``ids, vec``: distinct vectors with their ``least`` smallest ids."""
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    few = found.select("id", "vec").distinct() if least > 1 else found
    return few.withColumn("place", place).where(F.col("place") <= least).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))


Search = Callable[[np.ndarray, np.ndarray], list[np.ndarray]]


def best(
    rows: DataFrame, *, key: str, vector: str, every: int, k: int, index: Callable[[np.ndarray], Search], prepare=lambda df: df, score_type: str = "double",
    of: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = BLOCK, chunk: int = CHUNK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is a multiple of ``every`` the ``k`` best rows with another id.

    ``index(matrix)`` readies a block; the search it returns takes (queries, number of vectors wanted) and gives for each
    query the places that it visited and that may be among its best. ``of(query, matrix)`` is the exact score. Rows that
    repeat an id and a vector count once. A row whose id occurs with several vectors takes part with each; as a query, the
    id is asked with each and takes its best. Vectors of another length than the query's aren't compared.
    """
    spark = rows.sparkSession
    shelf = Shelf(spark, "search")
    found = shelf.put(prepare(usable(rows, key=key, vector=vector)))
    indexed = classes(found, k + 1)
    n_rows = found.count()
    blocks = max(1, -(-n_rows // block))
    if blocks > 1:
        indexed = shelf.put(indexed.repartition(blocks, F.xxhash64("vec")))
    else:
        indexed = shelf.put(indexed.coalesce(1))
    queries = found.where(F.pmod("id", F.lit(every)) == 0).distinct()
    chunks = max(1, -(-queries.count() // chunk))
    parts = []
    for c in range(chunks):
        own = queries if chunks == 1 else queries.where(F.pmod(F.xxhash64("id", "vec"), F.lit(chunks)) == c)
        got = own.toArrow()
        q_ids, q_vecs = got.column("id").to_numpy(), got.column("vec").to_pylist()
        order = np.argsort(q_ids, kind="stable")
        q_ids, q_vecs = q_ids[order], [np.array(q_vecs[i]) for i in order]
        parts.append(shelf.put(_search(indexed, q_ids, q_vecs, k, index, of, score_type, block)))
    every_part = parts[0]
    for p in parts[1:]:
        every_part = every_part.union(p)
    merged = every_part.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(indexed: DataFrame, q_ids: np.ndarray, q_vecs: list[np.ndarray], k: int, index, of, score_type: str, block: int) -> DataFrame:
    q_sizes = np.array([len(v) for v in q_vecs])

    def one(vecs: list[np.ndarray], ids: list[list[int]]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(v) for v in vecs])
        for size in np.unique(sizes).tolist():
            rows, asked = np.flatnonzero(sizes == size), np.flatnonzero(q_sizes == size)
            if not len(asked):
                continue
            matrix = np.stack([vecs[i] for i in rows])
            queries = np.stack([q_vecs[i] for i in asked])
            # An id may have several vectors: so many vectors hold k + 1 ids at least.
            want = (k + 1) * int(np.unique(np.concatenate([ids[i] for i in rows]), return_counts=True)[1].max())
            out_q, out_v, out_s = [], [], []
            for q, visited in zip(asked, index(matrix)(queries, want)):
                scores = of(q_vecs[q], matrix[visited])
                if len(scores) > want:
                    top = np.flatnonzero(scores >= np.partition(scores, len(scores) - want)[len(scores) - want])
                else:
                    top = np.arange(len(scores))
                for i in top:
                    for v in ids[rows[visited[i]]]:
                        if v != q_ids[q]:
                            out_q.append(q_ids[q])
                            out_v.append(v)
                            out_s.append(scores[i])
            if out_q:
                q, v, s = np.array(out_q), np.array(out_v), np.array(out_s)
                order = np.lexsort((-s, v, q))  # an id's best score
                q, v, s = q[order], v[order], s[order]
                own = np.concatenate([[True], (q[1:] != q[:-1]) | (v[1:] != v[:-1])])
                q, v, s = q[own], v[own], s[own]
                order = np.lexsort((v, -s, q))
                q, v, s = q[order], v[order], s[order]
                first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
                near = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
                yield pa.RecordBatch.from_arrays([pa.array(q[near], pa.int64()), pa.array(v[near], pa.int64()), pa.array(s[near], pa.int64() if score_type == "long" else pa.float64())], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vecs: list[np.ndarray] = []
        ids: list[list[int]] = []
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vec"))
            flat, ends = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            vecs.extend(flat[ends[i] : ends[i + 1]] for i in range(len(column)))
            ids.extend(batch.column(batch.schema.get_field_index("ids")).to_pylist())
            while len(vecs) >= 2 * block:
                yield from one(vecs[:block], ids[:block])
                vecs, ids = vecs[block:], ids[block:]
        if vecs:
            yield from one(vecs, ids)

    return indexed.mapInArrow(lean(run), f"query_id long, vec_id long, score {score_type}")
