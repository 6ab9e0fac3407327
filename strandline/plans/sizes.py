"""Broadcasts behind a check of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases, and their bytes, that may become part of a plan.
MOST_PHRASES, MOST_BYTES = 20_000, 4 << 20
#: Phrases that may be sent to every task as numbers, sixteen bytes each.
MOST_HASHED = 10_000_000
#: Rows of narrow keys that may be sent to every executor.
MOST = 200_000


def small(df: DataFrame, most: int = MOST) -> bool:
    """Whether a table has at most ``most`` rows; counting stops beyond."""
    return df.limit(most + 1).count() <= most


def few_phrases(df: DataFrame, column: str) -> list[str] | None:
    """The distinct values of a column if they are few and short, else nothing; at most ``MOST_PHRASES`` come to the driver."""
    few = df.select(column).distinct()
    if not small(few, MOST_PHRASES) or (few.agg(F.sum(F.octet_length(column))).first()[0] or 0) > MOST_BYTES:
        return None
    return sorted(r[0] for r in few.collect())


def sent_if_small(df: DataFrame, most: int = MOST) -> DataFrame:
    """``df`` with a broadcast hint if it is small; else to be joined by shuffle with AQE's skew handling.

    The second hint is needed too: AQE goes by compressed bytes, and a table of ten times as many in memory would pass through the driver.
    """
    return F.broadcast(df) if small(df, most) else df.hint("merge")
