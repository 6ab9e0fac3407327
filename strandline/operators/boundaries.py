"""Sentence boundaries learned from the corpus, without labels.

A word that nearly always carries a period is an abbreviation: for each word a likelihood
ratio says how much better "a period follows it as a rule" explains its counts than "a
period follows it as it follows any word". Short words, and words with periods inside, are
favoured; each time the word stands without one counts against it. The counts are one pass of
group-by over the corpus. Texts are then split row by row: after ``!`` and ``?``, and after a
period unless its word is an abbreviation, an initial, or a number before a small letter.
Pieces join to the text again, character by character, so offsets are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.members import members
from ..sources.shelf import Shelf, free_name
from . import grams

#: A word with a period, or without, then white space or the end; closing quotes and brackets may follow.
TOKEN = r"([\p{L}\p{N}_][\p{L}\p{N}_.'-]*)"
#: The number that the score of an abbreviation reaches at least, and the chance of a period after one.
LEAST, RULE = 0.3, 0.99
_CLOSE = r"[\"'\)\]]{0,3}"
_MARK = "\u0001\u001f\u0001"


def token_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``word, bare, dotted``: how often each lower-cased word stands without and with a period at its end; words with a letter."""
    tokens = F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(1))
    each = docs.select(F.explode(tokens).alias("token")).select(F.rtrim("token", F.lit(".")).alias("word"), F.endswith("token", F.lit(".")).alias("dot"))
    by = each.groupBy("word").agg(F.sum((~F.col("dot")).cast("long")).alias("bare"), F.sum(F.col("dot").cast("long")).alias("dotted"))
    return by.where(F.regexp_like("word", F.lit(r"\p{L}")))


def abbreviations(docs: DataFrame, *, text: str = "text", least: float = LEAST) -> DataFrame:
    """``word, bare, dotted, score`` of the words that are abbreviations. The counts are written once."""
    counts = Shelf(docs.sparkSession, "tokens").put(token_counts(docs, text=text))
    total = counts.agg(F.coalesce(F.sum("dotted"), F.lit(0)).alias("dots"), F.coalesce(F.sum(F.col("bare") + F.col("dotted")), F.lit(1)).alias("n")).first()
    p = min(max(total.dots / total.n, 1e-9), RULE - 1e-9)
    k, other = F.col("dotted").cast("double"), F.col("bare").cast("double")
    ratio = 2 * (k * F.lit(math.log(RULE) - math.log(p)) + other * F.lit(math.log(1 - RULE) - math.log(1 - p)))
    letters = F.length(F.replace("word", F.lit("."), F.lit(""))).cast("double")
    inner = (F.length("word") - letters + 1).cast("double")
    score = ratio * F.exp(-letters) * inner * F.pow(letters, -other)
    return counts.where("dotted > 0").withColumn("score", score).where(F.col("score") >= least)


def pieces(text: Column) -> Column:
    """The text cut after each ``.``, ``!`` or ``?`` and one white space: all places where a sentence may end."""
    return F.split(text, rf"(?<=[.!?]{_CLOSE}\s)")


def _ends(piece: Column, following: Column, known: Callable[[Column], Column]) -> Column:
    """Whether a sentence ends with a piece, given the next one."""
    small = F.regexp_like(following, F.lit(r"^\s*[\"'\(\[]{0,3}\p{Ll}"))
    end = F.regexp_replace(piece, r"(?s)^.*\s(?=\S+\s$)", "")  # the last word: the pattern below can't reach before it

    def cut(end: Column) -> Column:
        pattern = rf"(\S*?)([.!?]+){_CLOSE}\s$"
        return F.struct(F.lower(F.regexp_extract(F.regexp_extract(end, pattern, 1), rf"{TOKEN}$", 1)).alias("word"), F.regexp_extract(end, pattern, 2).alias("stops"))

    def stopped(x: Column) -> Column:
        word, stops = x["word"], x["stops"]
        initial = F.regexp_like(word, F.lit(r"^\p{L}$"))
        number = F.regexp_like(word, F.lit(r"^[0-9]+$"))
        return F.when(stops != ".", ~small | F.contains(stops, F.lit("!")) | F.contains(stops, F.lit("?"))).otherwise(~(initial | known(word) | (number & small)))

    return t.let(t.let(end, cut), stopped)


def splitter(known: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A function of a text column: its sentences, which join to the text again. ``known`` tells abbreviations."""

    def split(text: Column) -> Column:
        def joined(p: Column) -> Column:
            ended = F.transform(p, lambda x, i: F.when((i < F.size(p) - 1) & _ends(x, F.get(p, i + 1), known), F.concat(x, F.lit(_MARK))).otherwise(x))
            return F.split(F.array_join(ended, ""), _MARK)

        return F.when(F.contains(text, F.lit(_MARK)), F.array(text)).otherwise(t.let(pieces(text), joined))

    return split


def with_sentences(docs: DataFrame, short: DataFrame, *, text: str = "text", out: str = "sentences") -> DataFrame:
    """``docs`` with ``out``, an array of ``start, end, sentence``: characters from 0, the end not included.

    ``short`` are the abbreviations, with ``word``. Few of them become a hash set in the plan; beyond the size check each text
    brings its own words with a period, which meet them in a join. The pieces in a row are the whole text; a null text has
    none, an empty one has one empty piece.
    """
    own = "abbreviations of the text"
    dotted = F.filter(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(1)), lambda w: F.endswith(w, F.lit(".")))
    each, known = members(docs, short, "word", text, F.transform(dotted, lambda w: F.rtrim(w, F.lit("."))), own)
    pieces_ = free_name(each, "pieces")
    cut = each.withColumn(pieces_, splitter(known)(F.col(text))).withColumn(out, grams.running(F.transform(pieces_, lambda x: F.length(x))))
    placed = F.zip_with(pieces_, out, lambda x, end: F.struct((end - F.length(x)).alias("start"), end.alias("end"), x.alias("sentence")))
    return cut.withColumn(out, placed).drop(own, pieces_)
