"""Numbers from texts and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WORD, contains_any, let


def round2(x: Column) -> Column:
    """Two decimals, halves to even."""
    return F.bround(x, 2)


def host_probability(text: Column, markers, extra: str) -> Column:
    """A quarter for each marker that occurs, more for a question mark and for one marker, at most 1."""
    low = F.lower(text)
    total = F.lit(0.0)
    for m in markers:
        total = total + F.when(F.contains(low, F.lit(m)), 0.25).otherwise(0.0)
    total = total + F.when(F.contains(text, F.lit("?")), 0.15).otherwise(0.0)
    total = total + F.when(F.contains(low, F.lit(extra)), 0.4).otherwise(0.0)
    return F.least(total, F.lit(1.0))


def visual_context(text: Column, triggers) -> Column:
    return contains_any(F.lower(text), triggers)


def token_counts(pieces: Column) -> Column:
    """Words of each sentence."""
    return F.transform(pieces, lambda s: F.regexp_count(s, F.lit(WORD)))


def moments(numbers: Column) -> Column:
    """Count, sum and sum of squares of an array of whole numbers, as one struct."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q"))
    return F.aggregate(numbers, zero, lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x.cast("long") * x).alias("q")))


def chaos(m: Column) -> Column:
    """Population deviation over mean plus one, times ten."""
    mean = m["s"] / m["n"]
    spread = F.sqrt(F.greatest(m["q"] / m["n"] - mean * mean, F.lit(0.0)))
    return F.when(m["n"] > 0, spread / (mean + 1) * 10).otherwise(0.0)


def complexity(distinct: Column, total: Column, mean: Column) -> Column:
    """Lexical diversity in percent plus half the mean sentence length."""
    return F.when(total > 0, distinct / total).otherwise(0.0) * 100 + mean * 0.5


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """The vector with length 1; a zero vector stays. The vector and its length are computed once for a row."""
    scaled = lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(v.cast("array<float>")))
    return let(v, scaled)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two timestamps to two decimals; 0 if the end is missing."""
    return F.coalesce(round2((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1_000_000), F.lit(0.0))
