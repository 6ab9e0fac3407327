"""Sentiment by a lexicon that grows from a few seed words.

Words that stand together more than chance would have it pass their scores on: in each
round a word's score is the mean of its neighbours', weighted by mutual information and
damped, and seeds keep theirs. A text's score is the mean over its words that the lexicon
has; a negation among the three words before turns a word's score round, an intensifier
raises it. The lexicon is a table that words meet in a join, however large it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.sizes import sent_if_small
from ..sources.shelf import Shelf

#: Words before a word that turn it or raise it, and by how much.
REACH, RAISE = 3, 1.5


def induced(pairs: DataFrame, seeds: DataFrame, *, rounds: int = 2, damping: float = 0.85) -> DataFrame:
    """``word, score``: ``seeds`` (``word, score``) spread over ``pairs`` (``a, b, m``, both orders, words as text) for some rounds.

    A word far from all seeds has no row. Seeds with a null word or score are none; repeated ones take their mean.
    """
    shelf = Shelf(pairs.sparkSession, "sentiment")
    fixed = shelf.put(seeds.where("word IS NOT NULL AND score IS NOT NULL").groupBy("word").agg(F.avg("score").alias("score")))
    scores = fixed
    for _ in range(rounds):
        met = pairs.join(sent_if_small(scores.select(F.col("word").alias("b"), "score")), "b")
        spread = met.groupBy(F.col("a").alias("word")).agg((F.lit(damping) * F.sum(F.col("m") * F.col("score")) / F.sum("m")).alias("score"))
        scores = shelf.put(fixed.unionByName(spread.join(sent_if_small(fixed.select("word")), "word", "left_anti")))
    return scores


def _before(words: Column) -> Column:
    """Each word with those up to ``REACH`` places before it."""
    return F.transform(words, lambda w, i: F.struct(w.alias("word"), F.slice(words, F.greatest(i - (REACH - 1), F.lit(1)), F.least(i, F.lit(REACH))).alias("before")))


def scored(docs: DataFrame, lexicon: DataFrame, *, key: str = "doc_id", text: str = "text", negations: Sequence[str] = (), intensifiers: Sequence[str] = ()) -> DataFrame:
    """``key, words, score``: how many words of a text the lexicon (``word``, each once, ``score``) has, and their mean; 0 without one.

    A row for each key; rows that repeat a key are taken together. Null and empty texts have no word.
    """
    each = docs.select(key, F.explode(t.let(t.words(F.col(text)), _before)).alias("x")).select(key, "x.*")
    near = lambda some: F.arrays_overlap("before", F.array(*map(F.lit, some))) if some else F.lit(False)
    factor = F.when(near(negations), -1.0).otherwise(1.0) * F.when(near(intensifiers), RAISE).otherwise(1.0)
    own = each.join(sent_if_small(lexicon.select("word", "score")), "word").groupBy(key).agg(F.count(F.lit(1)).alias("words"), F.avg(F.col("score") * factor).alias("score"))
    name = F.col(key).alias("of")
    every = docs.select(name).distinct().join(own.withColumnRenamed(key, "own"), F.col("of").eqNullSafe(F.col("own")), "left")
    return every.select(F.col("of").alias(key), F.coalesce("words", F.lit(0).cast("long")).alias("words"), F.coalesce("score", F.lit(0.0)).alias("score"))
