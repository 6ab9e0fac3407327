"""Lemmas from suffix paradigms that the corpus shows.

Two endings belong together if many stems take both: "walk-ed" and "walk-" on hundreds of
stems say that "-ed" goes back to "". Every word is split in all ways, words meet on their
stems, and pairs of endings are counted; a word's lemma is the shorter word that its best
supported pair leads to. All of it is joins over the vocabulary, which is narrow. Texts
meet their lemmas in the tasks, as numbers (128 bits tell words apart), without a shuffle;
only beyond ``MOST_SENT`` lemmas their words are joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.sizes import sent_if_small, small
from ..sources.shelf import Shelf
from . import grams

#: Letters of a stem at least and of an ending at most; stems that a pair of endings needs, documents that a word needs.
STEM, ENDING, SUPPORT, LEAST = 4, 4, 20, 3
#: Lemmas that may be sent to every task, 32 bytes each.
MOST_SENT = 4_000_000


def letters(text: Column) -> Column:
    """The lower-cased words of a text that are letters alone."""
    return F.filter(t.words(text), lambda w: F.regexp_like(w, F.lit(r"^\p{L}+$")))


def splits(docs: DataFrame, *, text: str = "text", least: int = LEAST) -> DataFrame:
    """``word, stem, ending``: all splits of the words in at least ``least`` documents."""
    words = docs.select(F.explode(F.array_distinct(letters(F.col(text)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)
    n = F.length("word")
    lengths = F.when(n >= STEM, F.sequence(F.greatest(F.lit(STEM), n - ENDING), n)).otherwise(F.array().cast("array<int>"))
    each = words.select("word", F.explode(lengths).alias("i"))
    return each.select("word", F.substring("word", F.lit(1), F.col("i")).alias("stem"), F.substring("word", F.col("i") + 1, F.lit(ENDING)).alias("ending"))


def _met(parts: DataFrame) -> DataFrame:
    """Words of one stem, the longer ending first: ``word, longer, lemma, shorter``. The vocabulary is shuffled, whatever its compressed size."""
    a = parts.select("stem", "word", F.col("ending").alias("longer"))
    b = parts.select("stem", F.col("word").alias("lemma"), F.col("ending").alias("shorter"))
    return a.join(b.hint("merge"), "stem").where(F.length("longer") > F.length("shorter"))


def lemma_table(docs: DataFrame, *, text: str = "text", least: int = LEAST, support: int = SUPPORT) -> DataFrame:
    """``word, lemma, support`` of the words that have a lemma other than themselves.

    Of several the one whose endings are best supported, then the shortest, then the first in order. Null and empty texts
    add no word.
    """
    shelf = Shelf(docs.sparkSession, "lemmas")
    parts = shelf.put(splits(docs, text=text, least=least))
    met = _met(parts)
    pairs = shelf.put(met.groupBy("longer", "shorter").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= support))
    best = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("support"), F.length("lemma"), "lemma"))
    return met.join(sent_if_small(pairs), ["longer", "shorter"]).withColumn("best", best).where("best = 1").select("word", "lemma", "support")


def distinct_lemmas(docs: DataFrame, table: DataFrame, *, key: str = "doc_id", text: str = "text", words: str | None = None) -> DataFrame:
    """``key, lemmas``: how many different lemmas each text has; a word without one is its own. Texts without a word aren't in it.

    ``words`` names a column of each text's distinct words, if there is one.
    """
    each = docs.select(key, F.explode(F.array_distinct(letters(F.col(text))) if words is None else words).alias("word"))
    found = each.join(sent_if_small(table.select("word", "lemma")), "word", "left").select(key, F.coalesce("lemma", "word").alias("lemma"))
    return found.groupBy(key).agg(F.countDistinct("lemma").alias("lemmas"))


class Numbered:
    """Words and their lemmas as two numbers each, sorted by the word's first."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows[:, np.lexsort((rows[1], rows[0]))]
        first = self.rows[0]
        starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(first) else np.zeros(0, np.int64)
        self.most = int(np.diff(np.append(starts, len(first))).max(initial=0))

    def lemmas(self, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lemmas' numbers; a word without one keeps its own."""
        a, b, c, d = self.rows
        at, to_h, to_g = np.searchsorted(a, h), h.copy(), g.copy()
        for j in range(self.most):
            k = np.minimum(at + j, len(a) - 1)
            hit = (a[k] == h) & (b[k] == g)
            to_h[hit], to_g[hit] = c[k[hit]], d[k[hit]]
        return to_h, to_g


def _numbers(word: Column) -> list[Column]:
    return [F.xxhash64(word), F.xxhash64(F.lit(1), word)]


def numbered(table: DataFrame) -> Numbered:
    """All of a lemma table; 32 bytes a row come to the driver, so ask for their number before."""
    got = table.select(*(x.alias(f"c{i}") for i, x in enumerate([*_numbers(F.col("word")), *_numbers(F.col("lemma"))]))).toArrow()
    return Numbered(np.stack([got.column(i).to_numpy().astype(np.int64) for i in range(4)]))


def with_distinct_lemmas(docs: DataFrame, table: DataFrame, *, words: str, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``lemmas``, the number of ``distinct_lemmas``, or 0, from a column of each text's distinct words."""
    if not small(table, MOST_SENT):
        return docs.join(distinct_lemmas(docs, table, key=key, words=words), key, "left").withColumn("lemmas", F.coalesce("lemmas", F.lit(0).cast("long")))
    sent = docs.sparkSession.sparkContext.broadcast(numbered(table))

    @F.arrow_udf("bigint")
    def counted(first: pa.Array, second: pa.Array) -> pa.Array:
        at, counts = grams._offsets(first), []
        h, g = (x.flatten().to_numpy(zero_copy_only=False) for x in (first, second))
        at = at - at[0]
        for a, b in grams._stretches(at):
            own = at[a : b + 1]
            row = np.repeat(np.arange(b - a), np.diff(own))
            x, y = sent.value.lemmas(h[own[0] : own[-1]], g[own[0] : own[-1]])
            order = np.lexsort((y, x, row))
            x, y = x[order], y[order]
            new = np.ones(len(x), bool)
            new[1:] = (row[1:] != row[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            counts.append(np.bincount(row[new], minlength=b - a))
        return pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())

    first, second = (F.transform(words, lambda w: _numbers(w)[0]), F.transform(words, lambda w: _numbers(w)[1]))
    return docs.withColumn("lemmas", counted(first, second))
