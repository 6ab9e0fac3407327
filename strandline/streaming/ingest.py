"""The batch stages over a folder that grows: each new file is ingested once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as t
from ..operators import ingest
from ..params import Params

FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def stream_bronze(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "*.txt") -> StreamingQuery:
    """Write bronze rows of all files not yet ingested, then stop. The checkpoint remembers files across runs."""
    files = spark.readStream.schema(FILES).format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    named = files.select(F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("name"), "length", "content")
    return ingest.bronze(named).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()


def stream_phrase_counts(docs: DataFrame, out: str, checkpoint: str, p: Params, *, text: str = "raw_text") -> StreamingQuery:
    """Keep document frequencies of n-grams up to date: each micro-batch adds its own counts under its number.

    A repeated micro-batch overwrites its folder, so counts stay exact; ``phrase_counts`` sums them.
    """

    def add(batch: DataFrame, number: int) -> None:
        grams = t.ngrams(t.words(t.prefix(F.col(text), p.mining_chars)), p.ngram)
        counted = batch.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
        counted.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def phrase_counts(spark: SparkSession, out: str, p: Params) -> DataFrame:
    """``gram, df`` over all micro-batches, for the frequent ones."""
    return spark.read.parquet(out).groupBy("gram").agg(F.sum("df").alias("df")).where(F.col("df") >= p.min_phrase_docs)


def windowed_events(events: DataFrame, *, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """``start, event_type, n, total`` by event time, for a stream with a watermark or a batch."""
    own = events.withWatermark("ts", late) if events.isStreaming else events
    return own.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
