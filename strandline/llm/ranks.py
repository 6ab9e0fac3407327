"""Ranks inside groups of any size, by ranges of the whole order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shelf import Shelf


def ranked(rows: DataFrame, order: list[str], shelf: Shelf) -> DataFrame:
    """``rows`` with ``pos`` from 0 inside ``g`` in the order given, nulls first, and ``n``, the rows of the group.

    Ranges of the whole order are numbered by themselves; the numbers of the ranges before are added. Equal rows may stand in
    different ranges, so a group, a key or a row that repeats without end is no single task. ``rows`` is a written table
    and ``g`` is never null.
    """
    told = rows.withColumn("tie", F.monotonically_increasing_id())
    by = [F.col(c).asc_nulls_first() for c in ("g", *order, "tie")]
    ranges = shelf.put(told.repartitionByRange(*by).withColumn("range", F.spark_partition_id()))
    counts = ranges.groupBy("g", "range").agg(F.count(F.lit(1)).alias("own"))
    group = Window.partitionBy("g")  # one row a range
    before = F.sum("own").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")
    offsets = counts.withColumn("before", before).withColumn("n", F.sum("own").over(group)).select("g", "range", "before", "n")
    place = F.row_number().over(Window.partitionBy("g", "range").orderBy(*by[1:])) - 1
    out = ranges.withColumn("place", place).join(offsets, ["g", "range"])
    return out.withColumn("pos", F.col("before") + F.col("place")).drop("place", "before", "range", "tie")
