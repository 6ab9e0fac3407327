"""Sentence-aligned overlapping chunks, and the corpora made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as s
from ..functions import text as t
from ..params import Params
from ..sources.shelf import free_name

_BOUNDS = "array<struct<first:int,last:int>>"


def chunk_bounds(lengths: Column, p: Params) -> Column:
    """(first, last) sentence of each chunk, from 1, packed greedily.

    Before a sentence is added that would pass ``chunk_size``, a chunk of at least ``min_chunk`` characters closes; the next
    one begins with the sentences before that fit into ``chunk_overlap`` together. Lengths leave out the blanks between.
    """
    start = F.struct(F.lit(0).alias("i"), F.lit(1).alias("first"), F.lit(0).alias("size"), F.array().cast(_BOUNDS).alias("done"))

    def step(a: Column, n: Column) -> Column:
        i = a["i"] + 1
        closes = (a["size"] + n > p.chunk_size) & (a["size"] >= p.min_chunk)
        back = F.reverse(F.slice(lengths, a["first"], i - a["first"]))
        fit = F.aggregate(
            back,
            F.struct(F.lit(0).alias("k"), F.lit(0).alias("sum"), F.lit(True).alias("open")),
            lambda b, x: F.when(b["open"] & (b["sum"] + x <= p.chunk_overlap), F.struct((b["k"] + 1).alias("k"), (b["sum"] + x).alias("sum"), F.lit(True).alias("open"))).otherwise(F.struct(b["k"].alias("k"), b["sum"].alias("sum"), F.lit(False).alias("open"))),
        )
        after = F.struct(i.alias("i"), (i - fit["k"]).alias("first"), (fit["sum"] + n).alias("size"), F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), (i - 1).alias("last")))).alias("done"))
        return F.when(closes, after).otherwise(F.struct(i.alias("i"), a["first"].alias("first"), (a["size"] + n).alias("size"), a["done"].alias("done")))

    close = lambda a: F.when(a["i"] > 0, F.concat(a["done"], F.array(F.struct(a["first"].alias("first"), a["i"].alias("last"))))).otherwise(a["done"])
    return F.aggregate(lengths, start, step, close)


def exploded(docs: DataFrame, p: Params, *, text: str = "content_body") -> DataFrame:
    """``docs`` with ``ordinal, first, last, text_content``, a row for each chunk, in place of ``text``. No shuffle."""
    body = t.prefix(F.col(text), p.chunk_chars)
    made, sizes, bounds = (free_name(docs, c) for c in ("pieces", "sizes", "bounds"))
    pieces = docs.withColumn(made, F.when(F.length(body) > 0, p.split(body)).otherwise(F.array().cast("array<string>")))
    sized = pieces.withColumn(sizes, F.transform(made, lambda x: F.length(x)))
    rest = [c for c in docs.columns if c != text]
    out = sized.select(*rest, made, F.posexplode(chunk_bounds(F.col(sizes), p)).alias("ordinal", bounds))
    first, last = F.col(bounds)["first"], F.col(bounds)["last"]
    content = F.array_join(F.slice(made, first, last - first + 1), " ")
    return out.select(*rest, "ordinal", first.alias("first"), last.alias("last"), content.alias("text_content"))


def chunks(gold: DataFrame, p: Params, *, key: str = "episode_id", text: str = "content_body", guests: str = "nlp_guests") -> DataFrame:
    """The chunk table of gold rows."""
    lex = p.lexicons
    stage = F.when((F.col("business_start_index") > 0) & (F.col("ordinal") < p.banter_chunks), "Feedforward").otherwise("Business")
    return exploded(gold, p, text=text).select(
        F.format_string("%s-%04d", F.col(key).cast("string"), "ordinal").alias("chunk_id"),
        F.col(key).alias("episode_id"),
        "text_content",
        F.col(guests).alias("guest_list"),
        "top_concepts",
        F.col("chaos_score").alias("episode_chaos"),
        stage.alias("stage"),
        s.host_probability(F.col("text_content"), lex.host_markers, lex.extra_marker).alias("host_probability"),
        s.visual_context(F.col("text_content"), lex.chunk_visual_triggers).alias("has_visual_context"),
    )


def host_corpus(table: DataFrame, p: Params) -> DataFrame:
    """``text, meta``: chunks that the host probably speaks, without visual context."""
    good = (F.col("host_probability") >= p.host_cut) & ~F.col("has_visual_context") & (F.length("text_content") > p.host_min_chars)
    return table.where(good).select(F.col("text_content").alias("text"), F.struct("chunk_id", "episode_id", "stage", F.col("host_probability").alias("score")).alias("meta"))


def visual_corpus(table: DataFrame) -> DataFrame:
    """``text, meta``: chunks with visual context."""
    return table.where("has_visual_context").select(F.col("text_content").alias("text"), F.struct("chunk_id", "episode_id").alias("meta"))
