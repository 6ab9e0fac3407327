"""Mixing sources to target weights.

Sizes are summed by source; each source gets a share of the total by weight, at
most ``most`` times its own size, and what a capped source can't take is shared
out again among the others, until none is above. Each such round is one sum over
the table of sources, which may be long: nothing of it meets in one task, and
ranks come from ranges of it. The ratio target / size is the repetition rate: a
document is emitted ``floor(rate)`` times, and once more if a number in [0, 1)
derived from its id is below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shelf import Shelf, free_name

WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most so many sources is sent to every executor; a larger one is joined by shuffle.
MOST_SENT = 20_000
#: The columns that ``mix`` adds.
MADE = ("size", "source_size", "target", "copies", "taken")


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chance(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the seed and the key alone; null and empty keys count as one."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def default_weight(rank: Column) -> Column:
    """1, 2, 3 and again, by the rank of the source from 0."""
    return (F.pmod(rank, F.lit(3)) + 1).cast("long")


def ranked(by: DataFrame, shelf: Shelf) -> DataFrame:
    """``by`` with ``rank`` from 0 in order of ``source``, null last: ranges are ranked by themselves, after the rows of those before."""
    ranges = shelf.put(by.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()))
    before, rows = 0, []
    for r in ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).orderBy("range").collect():  # one row a task
        rows.append((r.range, before))
        before += r.n
    offsets = by.sparkSession.createDataFrame(rows, "range int, before long")
    place = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranges.withColumn("place", place).join(F.broadcast(offsets), "range").withColumn("rank", F.col("place") + F.col("before")).drop("place", "range", "before")


def source_targets(sizes: DataFrame, shelf: Shelf | None = None, *, source: str, size: str, most: int = 3, weight=default_weight) -> DataFrame:
    """One row a source: ``source, source_size, weight, target``. Sources rank by code point with null last."""
    shelf = shelf or Shelf(sizes.sparkSession, "targets")
    by = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    by = shelf.put(ranked(by, shelf).withColumn("weight", weight(F.col("rank"))).withColumn("cap", F.col("source_size") * F.lit(most)).drop("rank"))
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    sums = [F.coalesce(F.sum(whole(c)), F.lit(0)).cast("decimal(38,0)").alias(c) for c in ("cap", "weight")]
    total = int(by.agg(F.coalesce(F.sum(whole("source_size")), F.lit(0))).first()[0])
    every = int(by.agg(*sums).first()["weight"])
    left, open_, capped = total, every, F.lit(False)
    while open_:
        # A source whose share of what is left reaches its cap is capped; shares of the others only grow.
        capped = whole("cap") * F.lit(open_).cast("decimal(38,0)") <= whole("weight") * F.lit(left).cast("decimal(38,0)")
        taken = by.where(capped).agg(*sums).first()
        new = total - int(taken["cap"]), every - int(taken["weight"])
        if new == (left, open_):
            break
        left, open_ = new
    share = (F.col("weight") * F.lit(left).cast("long")).cast("double") / F.lit(float(max(1, open_)))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(share)
    return by.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", most: int = 3, seed: str = "mix", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``size, source_size, target, copies, taken``; nothing is emitted or dropped here.

    Null text: size 0. Null source: a source of its own. Null key: drawn like an
    empty one. Repeated rows: each is taken alike. An empty table gives an empty
    one. Input columns of those five names are replaced.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark, "mix")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in MADE]
    sized = docs.withColumn("size", n_words(docs[text]))
    narrow = keep is not None
    if narrow:  # sizes are written once, so the texts are read once
        sized = shelf.put(sized.select(*dict.fromkeys([*kept, source, key]), "size"))
    by = source_targets(sized, shelf, source=source, size="size", most=most)
    few = by.limit(MOST_SENT + 1).collect()
    s = free_name(sized, "source_of_target")
    right = by.select(F.col("source").alias(s), "source_size", "target")
    if len(few) <= MOST_SENT:
        right = F.broadcast(spark.createDataFrame([(r.source, r.source_size, r.target) for r in few], right.schema))
    # Beyond the bound the hot source is split by AQE: the join has no hint and nothing grouped above it.
    out = sized.join(right, sized[source].eqNullSafe(right[s]), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    extra = (chance(F.col(key), seed) < rate - whole).cast("long")
    out = out.withColumn("copies", whole + extra)
    return out.select(*kept, "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each document ``copies`` times."""
    n = free_name(mixed, "copy_no")
    return mixed.where("copies > 0").withColumn(n, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*columns)
