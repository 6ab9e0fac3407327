"""Whether strings of a row are in a table, for tables of any size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import few_phrases


def members(docs: DataFrame, table: DataFrame, column: str, text: str, asked: Column, own: str) -> tuple[DataFrame, Callable[[Column], Column]]:
    """``docs``, and a function that says whether a string of the row is in ``table``.

    Few strings become a hash set in the plan. Beyond the size check each text brings those that it will ask for (``asked``, an
    array), they meet the table in a join, and those found come back to the text, by two hashes of it, as a column named ``own``.
    """
    few = few_phrases(table.where(F.col(column).isNotNull()), column)
    if few is not None:
        return docs, lambda w: w.isin(few) if few else F.lit(False)
    by = [f"{n} hash for {own}" for n in ("first", "second")]
    marked = docs.withColumns({by[0]: F.xxhash64(text), by[1]: F.xxhash64(F.lit(1), F.col(text))})
    words = marked.select(*by, F.explode(F.array_distinct(asked)).alias(column))
    found = words.join(table.select(column).distinct(), column, "left_semi").groupBy(*by).agg(F.collect_set(column).alias(own))
    each = marked.join(found, by, "left").withColumn(own, F.coalesce(own, F.array().cast("array<string>"))).drop(*by)
    return each, lambda w: F.array_contains(own, w)
