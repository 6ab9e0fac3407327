"""Exact nearest neighbours that visit only where a neighbour can be.

Equal vectors are one vector with its least keys, so copies are compared once. Some vectors are pivots; each
belongs to the cell of a nearest pivot, a large cell is cut into rings by distance from it and a ring
into blocks of bounded size. By the triangle inequality a query at distance ``a`` from a pivot has nothing of a ring
``low..high`` nearer than ``a - high`` or ``low - a``. A first look into one block gives each
query a bound on its k-th distance; then it meets the blocks whose rings can hold something within
the bound. A block and all its queries are one product of matrices, which leaves over the few pairs
that its rounding can't decide; those are computed by the plain definition. Rows are
exact whatever the pivots are; vectors without any structure visit everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shelf import Shelf

#: Vectors of a block; pivots at most; rings of a cell at most; queries that meet a block at once.
BLOCK, PIVOTS, RINGS, ASKED = 8192, 256, 16, 1 << 16
#: Pairs compared at once.
PAIRS = 1 << 20


@dataclass(frozen=True)
class Found:
    """``rows``: ``query_id, rank, key, distance``; ``visited``: ``query_id, visited``, the vectors that a query was compared with in the second look."""

    rows: DataFrame
    visited: DataFrame


def _rounding(size: int) -> float:
    """What a squared distance from products can be off by, for each unit of the two squared lengths."""
    return 8 * (size + 8) * np.finfo(float).eps


def _squares(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by a product of matrices, and for each row a bound of their error; what overflows is below all bounds."""
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = (own * own).sum(1), (other * other).sum(1)
        out = own @ other.T
        out *= -2
        out += a[:, None]
        out += b[None, :]
        error = _rounding(own.shape[1]) * (a + b.max(initial=0)) + 1e-300
    if not np.isfinite(error).all():
        out[np.isnan(out)] = -np.inf
    return out, error


class Cells:
    """The pivots, bounded in number; after ``measure`` also the rings of their cells. It travels to the tasks."""

    def __init__(self, pivots: list[list[float]]):
        self.by_size: dict[int, tuple[int, np.ndarray]] = {}
        at = 0
        for size in sorted({len(p) for p in pivots}):
            own = np.array([p for p in pivots if len(p) == size], float)
            self.by_size[size] = at, own
            at += len(own)

    def measure(self, rings: list[tuple[int, int, float, float, int, int]]) -> list[tuple[int, int, int, int]]:
        """Rings as (cell, ring, low, high, vectors, parts); gives (cell, ring, first block, parts)."""
        rings = sorted(rings)
        get = lambda i, kind: np.array([r[i] for r in rings], kind)
        self.cell, self.n, self.parts = get(0, np.int64), get(4, np.int64), get(5, np.int64)
        self.low, self.high = get(2, float) * (1 - 1e-12), get(3, float) * (1 + 1e-12)  # room for the rounding of distances
        self.first = np.cumsum(self.parts) - self.parts
        return [(r[0], r[1], int(f), r[5]) for r, f in zip(rings, self.first)]

    def near(self, vectors: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """The number of the first pivot of this length and bounds of the distances from all of them; without one the only cell is ``-length``, at no distance."""
        size = vectors.shape[1]
        if size not in self.by_size:
            return -size, np.zeros((len(vectors), 1)), np.zeros((len(vectors), 1))
        first, own = self.by_size[size]
        square, error = _squares(vectors, own)
        with np.errstate(invalid="ignore"):
            low, high = np.sqrt(np.maximum(square - error[:, None], 0)), np.sqrt(square + error[:, None])
        return first, np.nan_to_num(low, nan=0.0), np.nan_to_num(high, nan=np.inf, posinf=np.inf)

    def placed(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A cell whose pivot is nearest up to rounding, and the distance from it."""
        first, low, _ = self.near(vectors)
        best = low.argmin(1)
        if first < 0:
            return first + best, np.zeros(len(vectors))
        with np.errstate(over="ignore"):
            gap = vectors - self.by_size[vectors.shape[1]][1][best]
            return first + best, np.sqrt((gap * gap).sum(1))


def _matrices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The places of the vectors of each length and their matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    begin = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, flat.reshape(-1, size) if len(at) == len(sizes) else flat[begin[at][:, None] + np.arange(size)]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _placed(rows: DataFrame, cells: Cells) -> DataFrame:
    """``rows`` with ``cell`` and ``d``, the distance from its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, d = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for at, matrix in _matrices(_column(batch, "v")):
                for i in range(0, len(at), 1024):
                    some = at[i : i + 1024]
                    cell[some], d[some] = cells.placed(matrix[i : i + 1024])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(d)], names=[*batch.schema.names, "cell", "d"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("d", T.DoubleType())]))


def _slack(x: np.ndarray) -> np.ndarray:
    """A bound with room for the rounding of distances."""
    return x * (1 + 1e-9) + 1e-9


def _dealt(placed: DataFrame, block: int, shelf: Shelf) -> DataFrame:
    """``placed`` with ``ring, part, parts``: a cell of more than ``block`` vectors is cut into about as many rings as it fills blocks, at most ``RINGS``."""
    by = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("d", [i / RINGS for i in range(1, RINGS)], 2000).alias("cuts"))
    step = F.greatest(F.lit(1), F.floor(F.lit(RINGS) / F.ceil(F.col("n") / block))).cast("int").alias("step")
    by = by.select("cell", "n", "cuts", step)
    cuts = F.array_distinct(F.filter("cuts", lambda c, i: (i + 1) % F.col("step") == 0))
    by = by.withColumn("cuts", F.when(F.col("n") > block, cuts).otherwise(F.array().cast("array<double>")))
    by = by.select("cell", "cuts", F.greatest(F.lit(1), F.ceil(F.col("n") / ((F.size("cuts") + 1) * block))).cast("int").alias("parts"))  # at most PIVOTS rows and one a length
    ring = F.size(F.filter("cuts", lambda c: c < F.col("d"))).alias("ring")
    part = F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part")
    return placed.join(F.broadcast(shelf.put(by)), "cell").select("cell", ring, part, "parts", "d", "ids", "v")


def _compared(blocks: DataFrame, visits: DataFrame, want: int, n_asked: int) -> DataFrame:
    """``q, ids, distance``: the ``want`` best vectors of each block for each query within its bound, ties to the least key."""
    slices = -(-n_asked // ASKED)
    if slices > 1:  # a block meets so many queries at once, and is sent again for the others
        blocks = blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    else:
        blocks = blocks.withColumn("slice", F.lit(0))
    visits = visits.withColumn("slice", F.pmod("q", F.lit(max(1, slices))).cast("int"))
    ids_type = blocks.schema["ids"].dataType

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        ids, names = rows.column("ids").combine_chunks(), ["q", "ids", "distance"]
        out = [pa.table([pa.array([], pa.int64()), ids.slice(0, 0), pa.array([], pa.float64())], names=names)]
        if not rows.num_rows or not asked.num_rows:
            return out[0]
        least = pc.rank(pc.list_element(ids, 0), sort_keys="ascending", tiebreaker="first").to_numpy(zero_copy_only=False)
        numbers, bounds = (asked.column(c).to_numpy() for c in ("q", "bound"))
        theirs = {own.shape[1]: (places, own) for places, own in _matrices(asked.column("v"))}
        for at, matrix in _matrices(rows.column("v")):
            if matrix.shape[1] not in theirs:
                continue
            order = np.argsort(least[at])  # places in the order of keys
            at, matrix = at[order], matrix[order]
            places, own = theirs[matrix.shape[1]]
            step = max(1, PAIRS // len(matrix))
            for i in range(0, len(own), step):
                mine, now = own[i : i + step], places[i : i + step]
                q, r, total = _best(mine, matrix, bounds[now], want)
                out.append(pa.table([pa.array(numbers[now[q]]), ids.take(pa.array(at[r])), pa.array(total)], names=names))
        return pa.concat_tables(out)

    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("ids", ids_type), T.StructField("distance", T.DoubleType())])
    return blocks.select("block", "slice", "ids", "v").groupBy("block", "slice").cogroup(visits.select("block", "slice", "q", "v", "bound").groupBy("block", "slice")).applyInArrow(run, schema)


def _best(own: np.ndarray, matrix: np.ndarray, bounds: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and squared distance of each query's ``want`` nearest rows within its bound, ties to the first row."""
    square, error = _squares(own, matrix)
    with np.errstate(over="ignore"):
        limit = bounds * bounds * (1 + 1e-9) + error
        mask = square <= limit[:, None]
        many = np.flatnonzero(mask.sum(1) > 4 * want)
        if len(many) and want < len(matrix):
            limit[many] = np.fmin(limit[many], np.partition(square[many], want - 1, axis=1)[:, want - 1] + 2 * error[many])
            mask[many] = square[many] <= limit[many, None]
        q, r = np.nonzero(mask)
        total = np.zeros(len(q))
        for c in range(matrix.shape[1]):  # in the order of the plain definition, so that sums agree to the bit
            gap = matrix[r, c] - own[q, c]
            total += gap * gap
    order = np.lexsort((r, total, q))
    q, r, total = q[order], r[order], total[order]
    begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    keep = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q)))) < want
    return q[keep], r[keep], total[keep]


def nearest_each(table: DataFrame, queries: DataFrame, k: int = 3, *, key: str = "vec_id", own: bool = False, block: int = BLOCK, pivots: int | None = None) -> Found:
    """The ``k`` nearest rows of each query of ``query_id, query``, by squared distance; any number of queries.

    Ties go to the smaller key. Unless ``own`` a row isn't its own neighbour. Rows that repeat key and vector count once, a key
    with several vectors takes its nearest, and so does a query. Null vectors, those with null or non-finite components and
    those of another length than the query's aren't compared; a null key is no row. ``pivots`` is about twice the square root of the
    number of vectors, at most ``PIVOTS``; they are the first distinct vectors by hash, and the only rows that come to the driver.
    """
    spark = table.sparkSession
    shelf = Shelf(spark, "nearest")
    finite = lambda v: v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = table.select(F.col(key).alias("id"), _plain(table, "vector").alias("v")).where(F.col("id").isNotNull() & finite(F.col("v")))
    # Of the keys with one vector only the k + 1 least can be among the nearest of a query: one may be its own.
    rank = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    rows = rows.withColumn("at", rank).where(F.col("at") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    rows = shelf.put(rows)
    n = rows.count()
    some = min(PIVOTS, pivots or max(1, round(2 * n**0.5)))
    cells = Cells([r.v for r in rows.select("v").orderBy(F.xxhash64("v"), "v").limit(some).collect()])
    dealt = _dealt(shelf.put(_placed(rows, cells)), block, shelf)
    rings = dealt.groupBy("cell", "ring").agg(F.min("d"), F.max("d"), F.count(F.lit(1)), F.max("parts")).collect()  # at most RINGS for a cell
    firsts = spark.createDataFrame(cells.measure([tuple(r) for r in rings]), "cell int, ring int, first int, parts int")
    blocks = dealt.drop("parts").join(F.broadcast(firsts), ["cell", "ring"]).select((F.col("first") + F.col("part")).alias("block"), "ids", "v")
    # An id may have several vectors: so many vectors hold k other ids at least.
    most = rows.select(F.explode("ids").alias("id")).groupBy("id").count().agg(F.max("count")).first()[0] or 1
    want = (k + 1) * most

    asked = queries.select("query_id", _plain(queries, "query").alias("v")).where(F.col("query_id").isNotNull() & finite(F.col("v"))).distinct()
    asked = shelf.put(asked)
    vectors = shelf.put(asked.select("v").distinct().withColumn("q", F.monotonically_increasing_id()))
    told = shelf.put(asked.join(vectors, "v").select("query_id", "q"))
    n_asked = vectors.count()

    # The first look: one block near the query; where it holds too few vectors, the cells' radii give the bound.
    looked = _compared(blocks, _home(vectors, cells), want, n_asked)
    near = looked.groupBy("q").agg(F.sort_array(F.collect_list("distance")).alias("x")).select("q", F.sqrt(F.get("x", F.lit(want - 1))).alias("near"))
    bounded = shelf.put(_bounded(vectors.join(near, "q", "left"), cells, want))

    # The second look: each query meets the blocks that can hold something within its bound.
    visits = bounded.select("q", "v", "bound", F.explode("blocks").alias("block"))
    found = _compared(blocks, visits, want, n_asked)
    first = F.row_number().over(Window.partitionBy("q").orderBy("distance", F.get("ids", F.lit(0))))
    found = shelf.put(found.withColumn("at", first).where(F.col("at") <= want).drop("at"))
    hits = told.join(found, "q").select("query_id", F.explode("ids").alias(key), "distance").groupBy("query_id", key).agg(F.min("distance").alias("distance"))
    if not own:
        hits = hits.where(F.col(key) != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", key))
    best = hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "distance")
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    visited = visits.select("q", "block").join(sizes, "block").groupBy("q").agg(F.sum("n").alias("n"))
    return Found(best, told.join(visited, "q").groupBy("query_id").agg(F.sum("n").alias("visited")))


def _plain(df: DataFrame, column: str):
    """A column of vectors; floats stay as they are, which is half the bytes, and count as doubles."""
    kind = df.schema[column].dataType
    floats = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return F.col(column) if floats else F.col(column).cast("array<double>")


def _home(queries: DataFrame, cells: Cells) -> DataFrame:
    """``q, v, bound, block``: a block of the ring that is nearest to the query's distance in its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, numbers = np.full(batch.num_rows, -1), _column(batch, "q").to_numpy()
            for at, matrix in _matrices(_column(batch, "v")):
                cell, d = cells.placed(matrix)
                for c in np.unique(cell):
                    rings, own = np.flatnonzero(cells.cell == c), np.flatnonzero(cell == c)
                    if len(rings):
                        gap = np.maximum(np.maximum(cells.low[rings][None] - d[own][:, None], d[own][:, None] - cells.high[rings][None]), 0)
                        ring = rings[gap.argmin(1)]
                        home[at[own]] = cells.first[ring] + numbers[at[own]] % cells.parts[ring]
            made = pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(home), np.inf)), pa.array(home.astype(np.int32))], names=[*batch.schema.names, "bound", "block"])
            yield made.filter(pa.array(home >= 0))

    return queries.select("q", "v").mapInArrow(run, T.StructType([queries.schema["q"], queries.schema["v"], T.StructField("bound", T.DoubleType()), T.StructField("block", T.IntegerType())]))


def _bounded(queries: DataFrame, cells: Cells, want: int) -> DataFrame:
    """``q, v, bound, blocks``: the bound of the first look, or the radius within which the nearest cells have ``want`` vectors, and the blocks of the rings that can hold something within it."""

    def bounds(first: int, high: np.ndarray, near: np.ndarray) -> np.ndarray:
        if first < 0:
            return near
        radius, n = np.zeros(high.shape[1]), np.zeros(high.shape[1])
        own = (cells.cell >= first) & (cells.cell < first + high.shape[1])
        np.maximum.at(radius, cells.cell[own] - first, cells.high[own])
        np.add.at(n, cells.cell[own] - first, cells.n[own])
        full = high + radius
        order = full.argsort(1, kind="stable")
        held = np.cumsum(n[order], 1) >= want
        lines = np.arange(len(full))
        return np.fmin(near, np.where(held.any(1), full[lines, order[lines, held.argmax(1)]], np.inf))

    def needed(matrix: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, low, high = cells.near(matrix)
        bound = _slack(bounds(first, high, near))
        rings = np.flatnonzero((cells.cell >= first) & (cells.cell < first + low.shape[1]))
        cell = cells.cell[rings] - first
        meets = (low[:, cell] - cells.high[rings] <= bound[:, None]) & (cells.low[rings] - high[:, cell] <= bound[:, None])
        line, ring = np.nonzero(meets)
        return bound, line, rings[ring]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, PAIRS // (len(cells.cell) + 1))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                near = _column(batch, "near").to_numpy(zero_copy_only=False)
                near, bound = np.where(np.isnan(near), np.inf, near), np.full(batch.num_rows, np.inf)
                lines, firsts, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for at, matrix in _matrices(_column(batch, "v")):
                    bound[at], line, ring = needed(matrix, near[at])
                    lines.append(at[line]), firsts.append(cells.first[ring]), parts.append(cells.parts[ring])
                line, first, part = (np.concatenate(x) for x in (lines, firsts, parts))
                order = np.argsort(line, kind="stable")
                line, first, part = line[order], first[order], part[order]
                block = np.repeat(first - (np.cumsum(part) - part), part) + np.arange(part.sum())
                ends = np.concatenate([[0], np.cumsum(np.bincount(line, part, batch.num_rows))]).astype(np.int32)
                blocks = pa.ListArray.from_arrays(pa.array(ends), pa.array(block.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([_column(batch, "q"), _column(batch, "v"), pa.array(bound), blocks], names=["q", "v", "bound", "blocks"])

    return queries.select("q", "v", "near").mapInArrow(run, T.StructType([queries.schema["q"], queries.schema["v"], T.StructField("bound", T.DoubleType()), T.StructField("blocks", T.ArrayType(T.IntegerType()))]))
