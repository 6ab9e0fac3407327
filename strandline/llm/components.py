"""Connected components of a table of links, with tables in the shared folder between the levels."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .bytewords import mix
from .shelf import Shelf, lean

#: Links that a task holds at a time.
CHUNK = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every end of the links and the root of its component among these links: the node whose mixed number is lowest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    by_rank = np.argsort(mix(nodes.view(np.uint64)), kind="stable")
    rank = np.empty(len(nodes), np.int64)
    rank[by_rank] = np.arange(len(nodes))
    x, y = rank[at[: len(a)]], rank[at[len(a) :]]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes[by_rank], nodes[by_rank[label]]
        label = new


def _stars(links: DataFrame) -> DataFrame:
    """``node, root`` of the links that a task holds at a time; a root has a row of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
                held.clear()
                node, root = roots(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "root"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= CHUNK:
                yield from out()
        yield from out()

    return links.select("a", "b").mapInArrow(lean(run), "node long, root long")


def components(links: DataFrame, shelf: Shelf) -> DataFrame:
    """``node, label`` of every end of a link ``a, b`` (long): the label is the least node that can be reached.

    Each task replaces its links by stars, then a node that has several roots links them: a graph of the roots alone, whose
    stars are the next level. Roots are drawn by a mixed number, so a fair share of the nodes goes at each level, however
    they are numbered. Going back, a node takes the label of its root. ``links`` is read once, in tasks of at least about
    ``CHUNK`` links if there are as many.
    """
    levels = []
    rows = Observation()
    left = shelf.put(links.select("a", "b").observe(rows, F.count(F.lit(1)).alias("n")))
    many = rows.get["n"]
    while True:
        few = left.coalesce(max(1, ceil(many / CHUNK)))
        seen = Observation()
        level = _stars(few).groupBy("node").agg(F.min("root").alias("to"), F.collect_set("root").alias("roots"))
        level = shelf.put(level.observe(seen, F.sum(F.size("roots") - 1).alias("more")))
        levels.append(level)
        many = seen.get["more"] or 0
        if not many:
            break
        left = level.where(F.size("roots") > 1).select(F.explode("roots").alias("a"), F.col("to").alias("b")).where("a <> b")
    labels = levels.pop().select("node", F.col("to").alias("label"))
    while levels:
        up = labels.select(F.col("node").alias("to"), "label")
        labels = levels.pop().select("node", "to").join(up, "to", "left").select("node", F.coalesce("label", "to").alias("label"))
    labels = shelf.put(labels)
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return shelf.put(labels.join(least, "label").select("node", F.col("least").alias("label")))


def joined(labels: DataFrame, links: DataFrame, shelf: Shelf) -> DataFrame:
    """``labels`` after more links: only the labels at their ends are searched, then every node takes its label's new one."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = ends.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).where("a <> b")
    between = shelf.put(between.distinct())
    if not between.limit(1).count():
        return labels
    merged = components(between, shelf)
    new = merged.select(F.col("node").alias("label"), F.col("label").alias("to"))
    moved = labels.join(new, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return shelf.put(moved.union(merged).groupBy("node").agg(F.min("label").alias("label")))
