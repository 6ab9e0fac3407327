"""Silver to gold: features of each document.

All features are expressions over one row, so they take no shuffle. Concepts
are counted in tasks, for a batch of rows at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as s
from ..functions import text as t
from ..functions.providers import Expression, frequent_words, lexicon_sentiment
from ..params import Params
from ..sources.shelf import free_name
from . import grams


def sentence_stats(text: Column, p: Params) -> Column:
    """``n_sentences, n_words, n_long, long_words, chaos, mean`` of a text; ``long``: sentences above the least length."""
    counts = s.token_counts(p.split(t.prefix(text, p.feature_chars)))

    def stats(x: Column) -> Column:
        every, m = x["every"], x["long"]
        return F.struct(
            every["n"].alias("n_sentences"),
            every["s"].alias("n_words"),
            m["n"].alias("n_long"),
            m["s"].alias("long_words"),
            s.round2(s.chaos(m)).alias("chaos"),
            F.when(m["n"] > 0, m["s"] / m["n"]).otherwise(0.0).alias("mean"),
        )

    both = lambda c: F.struct(s.moments(c).alias("every"), s.moments(F.filter(c, lambda n: n > p.min_sentence_tokens)).alias("long"))
    return t.let(t.let(counts, both), stats)


def business_start(text: Column, p: Params) -> Column:
    """Offset of the first window of sentences, in steps, whose mean length is above the bound; 0 without one.

    The last full window isn't looked at.
    """
    pieces = F.split(F.regexp_replace(text, r"([.!?]\s+|\n)", "$1" + t.MARK), t.MARK)  # with the white space that ends them
    sized = F.transform(pieces, lambda x: F.struct(F.length(x).alias("chars"), F.regexp_count(x, F.lit(t.WORD)).alias("words")))

    def find(rows: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(rows) - p.window - 1, F.lit(0)), F.lit(p.stride))
        good = F.filter(places, lambda i: F.aggregate(F.slice(rows, i + 1, p.window), F.lit(0), lambda a, x: a + x["words"]) > p.window_mean * p.window)
        first = F.try_element_at(good, F.lit(1))
        offset = F.aggregate(F.slice(rows, 1, F.coalesce(first, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x["chars"])
        return F.when((F.size(rows) > p.window) & first.isNotNull(), offset).otherwise(F.lit(0)).cast("long")

    return t.let(sized, find)


def concept_counts(text: Column, p: Params, concepts: Expression | None = None) -> Column:
    """The most frequent concepts of a text as structs ``less, first, term``: minus the count and the place, ties by first occurrence."""
    find = concepts or frequent_words(p.min_concept_chars, p.lexicons.stop_concepts)

    return grams.most_frequent(find(t.prefix(text, p.concept_chars)), p.max_concepts)


def ranked_concepts(docs: DataFrame, p: Params, *, key: str, text: str, concepts: Expression | None = None) -> DataFrame:
    """``key, term, n, rank``: a document's most frequent concepts, ties by first occurrence."""
    each = docs.select(key, F.posexplode(concept_counts(F.col(text), p, concepts)).alias("place", "x"))
    return each.select(key, F.col("x.term").alias("term"), (-F.col("x.less")).cast("long").alias("n"), (F.col("place") + 1).alias("rank"))


def concept_list(text: Column, p: Params, concepts: Expression | None = None) -> Column:
    """A text's concepts in order of rank; none below ``min_feature_chars`` characters."""
    listed = F.transform(concept_counts(text, p, concepts), lambda x: x["term"])
    return F.when(F.length(text) >= p.min_feature_chars, listed).otherwise(F.array().cast("array<string>"))


def features(docs: DataFrame, p: Params, *, text: str = "content_body", sentiment: Expression | None = None, lemmas: Expression | None = None) -> DataFrame:
    """``docs`` with all features of one row. ``lemmas`` turns an array of lower-cased words into their lemmas.

    A null text or one below ``min_feature_chars`` characters has zeros; without a long sentence only the sentiment stays.
    """
    body = F.col(text)
    mood = s.round2((sentiment or lexicon_sentiment({}))(t.prefix(body, p.sentiment_chars)))
    alpha = F.filter(t.words(t.prefix(body, p.feature_chars)), lambda w: w.rlike(r"^\p{L}+$"))
    alpha = lemmas(alpha) if lemmas else alpha
    stats, letters = free_name(docs, "stats"), free_name(docs, "letters")
    with_stats = docs.withColumn(stats, sentence_stats(body, p)).withColumn(letters, alpha)
    st = F.col(stats)
    enough = body.isNotNull() & (F.length(body) >= p.min_feature_chars)
    full = enough & (st["n_long"] > 0)
    n = F.size(letters)
    rich = s.round2(s.complexity(F.size(F.array_distinct(letters)), n, st["mean"]))
    return with_stats.withColumns({
        "chaos_score": F.when(full, st["chaos"]).otherwise(0.0),
        "complexity_score": F.when(full, rich).otherwise(0.0),
        "sentiment": F.when(enough, mood).otherwise(0.0),
        "visual_event_count": F.when(full, t.phrase_hits(body, p.lexicons.visual_triggers)).otherwise(F.lit(0)).cast("long"),
        "business_start_index": F.when(full, business_start(t.prefix(body, p.feature_chars), p)).otherwise(F.lit(0)).cast("long"),
    }).drop(stats, letters)


def gold(docs: DataFrame, p: Params, *, text: str = "content_body", sentiment: Expression | None = None, concepts: Expression | None = None, lemmas: Expression | None = None) -> DataFrame:
    """Silver rows with all features and the concept list."""
    return features(docs, p, text=text, sentiment=sentiment, lemmas=lemmas).withColumn("top_concepts", concept_list(F.col(text), p, concepts))


def most(df: DataFrame, column: str, key: str, n: int = 3) -> DataFrame:
    """The rows with the highest values, ties by key: a bounded heap in each task."""
    return df.orderBy(F.desc(column), key).limit(n)
