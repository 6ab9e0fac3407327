"""Benchmark and trace reports, token counts, chat history."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scoring as s
from ..functions import text as t
from ..functions.providers import Expression


def last_turns(conversations: DataFrame, n: int = 4) -> DataFrame:
    """The last ``n`` turns of each conversation."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text")))
    return conversations.withColumn("back", place).where(F.col("back") <= n)


def run_benchmark(spark: SparkSession, prompts: list[tuple[str, str]], ask: Callable[[str], dict]) -> DataFrame:
    """One row for each prompt that succeeds: id, category, question, latency, sources, self-correction, preview."""
    rows = []
    for i, (category, query) in enumerate(prompts, 1):
        began = time.perf_counter()
        try:
            got = ask(query)
        except Exception:
            continue  # a failed prompt isn't counted
        rows.append((i, category, query, round(time.perf_counter() - began, 2), len(got.get("sources", [])), "rewrite" in got.get("steps_taken", []), got.get("response", "Error")))
    out = spark.createDataFrame(rows, "ID int, Category string, Question string, `Latency (s)` double, `Sources Used` int, `Self-Corrected` boolean, answer string")
    return out.withColumn("Answer Preview", t.preview(F.col("answer"))).drop("answer")


def benchmark_summary(results: DataFrame, latency: str = "Latency (s)", corrected: str = "Self-Corrected") -> DataFrame:
    """``prompts, mean_latency, correction_rate`` in percent."""
    return results.agg(F.count(F.lit(1)).alias("prompts"), s.round2(F.avg(F.col(f"`{latency}`"))).alias("mean_latency"), s.round2(100 * F.avg(F.col(f"`{corrected}`").cast("int"))).alias("correction_rate"))


def trace_report(traces: DataFrame) -> DataFrame:
    """``Input, Output, Latency, Status`` of traces."""
    return traces.select(
        F.coalesce("question", F.lit("N/A")).alias("Input"),
        F.coalesce("answer", F.lit("N/A")).alias("Output"),
        s.elapsed_seconds(F.col("start_time"), F.col("end_time")).alias("Latency"),
        F.col("status").alias("Status"),
    )


def token_estimate(files: DataFrame, text: str = "text", count: Expression | None = None) -> DataFrame:
    """``files, tokens``: tokens by ``count``, which gives a text's number; without it words, as an estimate."""
    n = F.coalesce(F.sum((count or t.word_count)(F.col(text)).cast("long")), F.lit(0)).cast("long")
    return files.agg(F.count(F.lit(1)).alias("files"), n.alias("tokens"))
