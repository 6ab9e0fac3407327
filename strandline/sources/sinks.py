"""Writers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, rows_per_file: int | None = None, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """zstd Parquet, with a bound on the rows of a file and folders by column if asked for."""
    w = df.write.mode(mode).option("compression", "zstd")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*by) if by else w).parquet(path)


def merged(df: DataFrame, path: str) -> None:
    """One file, for readers that need one. It passes through a single task: only for small results."""
    parquet(df.coalesce(1), path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def head(df: DataFrame, n: int = 10) -> str:
    """The first rows as a Markdown table."""
    rows = [df.columns, ["---"] * len(df.columns), *df.limit(n).collect()]
    return "\n".join("| " + " | ".join(str(x) for x in r) + " |" for r in rows)


def replace_table(df: DataFrame, name: str) -> None:
    """A catalogue table with these rows: written beside, then put in place, so a failed write keeps the old table."""
    spark, mark = df.sparkSession, uuid.uuid4().hex[:8]
    new, old = f"{name}_{mark}", f"{name}_{mark}_old"
    df.write.format("parquet").saveAsTable(new)
    had = spark.catalog.tableExists(name)
    if had:
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    try:
        spark.sql(f"ALTER TABLE {new} RENAME TO {name}")
    except Exception:
        if had:
            spark.sql(f"ALTER TABLE {old} RENAME TO {name}")
        raise
    if had:
        spark.sql(f"DROP TABLE {old}")


def append_table(df: DataFrame, name: str) -> None:
    """More rows for a catalogue table, by column name; the first ones make it."""
    if df.sparkSession.catalog.tableExists(name):
        df.select(*df.sparkSession.table(name).columns).write.insertInto(name)
    else:
        df.write.format("parquet").saveAsTable(name)


def unique(df: DataFrame, *keys: str) -> bool:
    """Whether no key repeats."""
    return not df.groupBy(*keys).count().where("count > 1").limit(1).count()


def vectors(df: DataFrame, name: str, vector: str, append: bool = False) -> None:
    """A vector table with the column named ``vector``: anew, or more rows for it."""
    (append_table if append else replace_table)(df.withColumnRenamed(vector, "vector"), name)


def in_batches(df: DataFrame, rows: int, send: Callable[[list[dict]], None]) -> None:
    """Call ``send`` with at most ``rows`` rows at a time, from the tasks: for stores that Spark doesn't write itself.

    A task that is run again sends its rows again, so ``send`` has to be an upsert.
    """

    def run(part) -> None:
        batch: list[dict] = []
        for r in part:
            batch.append(r.asDict(recursive=True))
            if len(batch) >= rows:
                send(batch)
                batch = []
        if batch:
            send(batch)

    df.foreachPartition(run)
