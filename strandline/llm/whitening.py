"""Whitening of embeddings by their leading principal components.

The covariance is never formed. A pass over the table takes a block of vectors Q and
returns XᵀXQ, X being the centred rows: every task adds up its rows and Spark adds the
tasks, so a pass brings back as many numbers as Q has. Block Lanczos builds an orthonormal
basis from such passes, each new block orthogonalised against all earlier ones, twice.
A block that loses rank (the basis has closed in itself) goes on with fresh random
directions, and a basis that reaches its bound starts anew from its best vectors. It
ends when the residuals of the wanted vectors are rounding, or the basis is the whole
space. Shares of variance come from the trace, which is the sum of the exact deviations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shelf import Shelf, lean

#: Fixed numbers of the integer form: floor(1024 * c) + 100000.
SCALE, SHIFT = 1024, 100_000


@dataclass(frozen=True)
class Search:
    """``block`` vectors a pass; residuals below ``tolerance`` of the largest eigenvalue end it; a basis holds ``most`` vectors."""

    block: int = 12
    tolerance: float = 1e-13
    most: int = 256
    passes: int = 400
    seed: int = 11


def finite(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))


def whole(vector: Column) -> Column:
    """The integer form of a vector."""
    return F.transform(vector, lambda c: F.floor(c * SCALE).cast("long") + SHIFT)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy().reshape(-1, width)


def summed(rows: DataFrame, of, size: int) -> np.ndarray:
    """The sum over all rows of ``of(matrix)``, ``size`` numbers: one set a task, added by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += of(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["cell", "v"])

    out = np.zeros(size)
    for r in rows.mapInArrow(lean(run), "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r.cell] = r.v
    return out


def product(rows: DataFrame, n: int, sums: np.ndarray, q: np.ndarray) -> np.ndarray:
    """XᵀXq / n of the centred rows."""
    d, b = q.shape

    def of(batch: pa.RecordBatch) -> np.ndarray:
        x = (n * _matrix(batch, d) - sums) / n  # exact before the division
        return (x.T @ (x @ q)).ravel()

    return summed(rows, of, d * b).reshape(d, b) / n


def fresh(basis: np.ndarray, candidates: np.ndarray, random: np.random.Generator, width: int) -> np.ndarray:
    """Orthonormal columns, at most ``width``: the candidates against the basis, random ones where they lose rank."""
    d = candidates.shape[0]
    width = min(width, d - basis.shape[1])
    got = np.zeros((d, 0))
    queue = [candidates[:, i] for i in range(candidates.shape[1])]
    while got.shape[1] < width:
        v = queue.pop(0) if queue else random.standard_normal(d)
        size = np.linalg.norm(v)
        if size == 0:
            continue
        v = v / size
        for _ in range(2):
            for known in (basis, got):
                v = v - known @ (known.T @ v)
        left = np.linalg.norm(v)
        if left > 1e-10:  # else it lies in what is known already
            v = v / left
            for known in (basis, got):
                v = v - known @ (known.T @ v)
            got = np.column_stack([got, v / np.linalg.norm(v)])
    return got


def leading(multiply, d: int, k: int, how: Search = Search()) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` largest eigenvalues and their vectors of the symmetric map ``multiply`` on ``d`` dimensions, and the passes taken."""
    random = np.random.default_rng(how.seed)
    k, width = min(k, d), min(max(how.block, 1), d)
    most = min(d, max(how.most, 2 * k + 2 * width))
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    block = fresh(basis, random.standard_normal((d, width)), random, width)
    for passes in range(1, how.passes + 1):
        y = multiply(block)
        basis, image = np.column_stack([basis, block]), np.column_stack([image, y])
        small = basis.T @ image
        e, s = np.linalg.eigh((small + small.T) / 2)
        e, s = e[::-1], s[:, ::-1]
        vectors = basis @ s[:, :k]
        off = np.linalg.norm(image @ s[:, :k] - vectors * e[:k], axis=0)
        done = basis.shape[1] >= d or (basis.shape[1] >= k + width and (off <= how.tolerance * max(abs(e[0]), 1e-300)).all())
        if done or passes == how.passes:
            return e[:k], vectors, passes
        if most < d and basis.shape[1] + width > most:  # start anew from the best vectors, whose images are known
            keep = min(basis.shape[1], k + width)
            turn = np.linalg.qr(s[:, :keep])[0]
            rest = y - basis @ (basis.T @ y)
            basis, image = basis @ turn, image @ turn
            y = rest
        block = fresh(basis, y, random, width)
    raise AssertionError


def whiten(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 8, how: Search = Search()) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``: a row for each usable row and component.

    A row takes part if its vector has entries, none null or not finite. The table's vectors have one length; of several
    lengths the most frequent one takes part (the longer in a tie). Repeated rows and null keys are rows like others. Components
    are numbered by falling eigenvalue; the largest entry of each is positive. Equal eigenvalues have some basis of their space.
    Directions without variance can't be whitened and are no components, so rows that are all equal, like an
    empty table, give no row. ``deviation`` is a long, or a decimal where its bound could pass one. Further columns aren't read.
    """
    shelf = Shelf(rows.sparkSession, "whiten")
    vec = rows[vector].cast("array<double>")
    good = shelf.put(rows.select(rows[key].alias("id"), vec.alias("v")).where(finite(F.col("v"))).select("id", whole(F.col("v")).alias("x")))
    sizes = good.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if sizes is None:
        return rows.sparkSession.createDataFrame([], schema)
    d, n = sizes["d"], sizes["count"]
    good = good.where(F.size("x") == d)
    place = good.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.min("c").alias("low"), F.max("c").alias("high")).orderBy("i").collect()
    sums = [int(r.s) for r in place]
    bound = sum(max(abs(n * r.low - s), abs(n * r.high - s)) ** 2 for r, s in zip(place, sums))
    fits = bound < 2**63 and all(abs(n * x) < 2**62 for r in place for x in (r.low, r.high))
    kind = "long" if fits else "decimal(38,0)"
    s_array = F.array(*(F.lit(s).cast(kind) for s in sums))
    off = F.zip_with("x", s_array, lambda x, s: x.cast(kind) * F.lit(n).cast(kind) - s)
    deviation = F.aggregate(off, F.lit(0).cast(kind), lambda a, o: (a + o * o).cast(kind))
    ready = shelf.put(good.select("id", "x", deviation.alias("deviation")))
    trace = float(ready.agg(F.sum(F.col("deviation").cast("decimal(38,0)"))).first()[0]) / float(n) ** 3
    centre = np.array(sums, np.int64 if fits else np.float64)
    e, vectors, _ = leading(lambda q: product(ready, n, centre, q), d, k, how)
    kept = int((e > 1e-12 * max(trace, 0)).sum()) if trace > 0 else 0
    if not kept:
        return rows.sparkSession.createDataFrame([], schema)
    e, vectors = e[:kept], vectors[:, :kept]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0)[0] < 0, -1, 1)
    scaled = vectors / np.sqrt(e)

    def project(batch: pa.RecordBatch) -> np.ndarray:
        return ((n * _matrix(batch, d) - centre) / n) @ scaled

    mean = summed(ready, lambda b: project(b).sum(0), kept) / n

    def spread(batch: pa.RecordBatch) -> np.ndarray:
        w = project(batch) - mean
        return (w.T @ w).ravel()

    error = float(np.abs(summed(ready, spread, kept * kept).reshape(kept, kept) / n - np.eye(kept)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names = [c for c in batch.schema.names if c != "x"]
                w = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * kept, pa.int32()), pa.array(project(batch).ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), w], names=[*names, "w"])

    # one row a vector out of Python; Spark spreads the components
    types = {f.name: f.dataType.simpleString() for f in ready.schema.fields}
    given = ready.mapInArrow(lean(run), f"id {types['id']}, deviation {types['deviation']}, w array<double>")
    shares = F.array(*(F.lit(float(x / trace)) for x in e))
    out = given.select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(key),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
