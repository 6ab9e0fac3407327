"""Bronze to silver: mining of repeated phrases, advertisement rules, cleaned text, guests.

Phrases are first counted by a 64-bit number made in tasks (``grams``), so that the wide
shuffle moves numbers and no text is built; only phrases that pass a filter of the frequent
numbers are counted again as text, which makes the result exact. The frequent numbers are
written once. Up to ``MOST_HASHED`` mined phrases are sent to the tasks, sixteen bytes each,
so texts are cleaned row by row without a shuffle; more of them meet the sentences in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.providers import Expression, capitalised_names
from ..params import Params
from ..plans import sizes
from ..sources.shelf import Shelf, free_name
from . import grams


def phrase_frequency(docs: DataFrame, p: Params, *, text: str = "raw_text", key: str = "episode_id") -> DataFrame:
    """``gram, df`` of the n-grams that occur in at least ``min_phrase_docs`` documents."""
    if p.mining_sample is not None:
        docs = docs.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(":42"))), key).limit(p.mining_sample)
    words = docs.select(t.words(t.prefix(F.col(text), p.mining_chars)).alias("words"))
    numbers = words.select(F.explode(grams.distinct_runs(grams.hashed(F.col("words")), p.ngram)).alias("h"))
    often = Shelf(docs.sparkSession, "phrases").put(numbers.groupBy("h").count().where(F.col("count") >= p.min_phrase_docs).select("h"))
    again = words.select(grams.runs_that_may(F.col("words"), p.ngram, docs, grams.bits_of(often, "h")).alias("grams"))
    counted = again.select(F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    return counted.where(F.col("df") >= p.min_phrase_docs)


def toxic_phrases(docs: DataFrame, p: Params, *, text: str = "raw_text", key: str = "episode_id") -> DataFrame:
    """The frequent n-grams that are not safe."""
    lex = p.lexicons
    return phrase_frequency(docs, p, text=text, key=key).where(~t.safe_phrase(F.col("gram"), lex.keywords, lex.safe_starters))


def _rule(sentence: Column, p: Params) -> Column:
    """1: equals a boilerplate line without punctuation; 2: a sponsor and a sales keyword; 0: neither."""
    lex = p.lexicons

    def ruled(low: Column) -> Column:
        first = t.without_punctuation(low).isin(*lex.boilerplate) if lex.boilerplate else F.lit(False)
        second = t.contains_any(low, lex.sponsors) & t.contains_any(low, lex.keywords)
        return F.when(first, 1).when(second, 2).otherwise(0)

    return t.let(F.lower(sentence), ruled)


def _pieces(text: Column, p: Params) -> Column:
    """``pos, sentence, rule`` of each sentence that isn't empty, by the first two rules."""
    stripped = F.transform(p.split(F.coalesce(text, F.lit(""))), t.strip)
    marked = F.transform(stripped, lambda x, i: F.struct(i.alias("pos"), x.alias("sentence"), _rule(x, p).alias("rule")))
    return F.filter(marked, lambda x: x["sentence"] != "")


def _long(x: Column, p: Params) -> Column:
    """Whether the third rule looks at a sentence."""
    return (x["rule"] == 0) & (F.length(x["sentence"]) > p.ad_min_chars)


def _ruled(docs: DataFrame, toxic: DataFrame, p: Params, text: str, key: str, made: str) -> DataFrame:
    """``docs`` with ``made``, the ``pos, sentence, rule`` of the text's sentences by all rules."""
    full = docs.withColumn(made, _pieces(F.col(text), p))
    hits = free_name(full, "hits")
    if toxic.count() <= sizes.MOST_HASHED:
        words = F.transform(made, lambda x: F.when(_long(x, p), grams.hashed(t.words(x["sentence"]))).otherwise(F.array().cast("array<bigint>")))
        full = full.withColumn(hits, grams.with_known(words, p.ngram, docs, grams.known(toxic, "gram", p.ngram)))
        hit = lambda x, i: F.get(hits, i)
    else:
        left = full.select(key, F.explode(F.filter(made, lambda x: _long(x, p))).alias("x"))
        numbers = toxic.select(F.explode(grams.distinct_runs(grams.hashed(F.split("gram", " ", -1)), p.ngram)).alias("h"))
        some = left.select(key, "x.pos", t.words(F.col("x.sentence")).alias("words"))
        some = some.select(key, "pos", grams.runs_that_may(F.col("words"), p.ngram, docs, grams.bits_of(numbers, "h")).alias("grams"))
        each = some.select(key, "pos", F.explode(F.array_distinct("grams")).alias("gram"))
        found = each.join(toxic.select("gram"), "gram", "left_semi").groupBy(key).agg(F.collect_set("pos").alias(hits))
        full = full.join(found, key, "left")
        hit = lambda x, i: (x["rule"] == 0) & F.coalesce(F.array_contains(hits, x["pos"]), F.lit(False))
    third = lambda x, i: F.struct(x["pos"].alias("pos"), x["sentence"].alias("sentence"), F.when(hit(x, i), 3).otherwise(x["rule"]).alias("rule"))
    return full.withColumn(made, F.transform(made, third)).drop(hits)


def sentence_rules(docs: DataFrame, toxic: DataFrame, p: Params, *, text: str = "raw_text", key: str = "episode_id") -> DataFrame:
    """``key, pos, sentence, rule`` of each sentence that isn't empty; the first matching rule wins, 0 is kept.

    Rule 3 is a frequent phrase in a sentence of more than ``ad_min_chars`` characters. Up to ``MOST_HASHED`` phrases are looked
    up in the tasks; more are met by a semi-join of those n-grams of the sentences left by the first two rules that pass a filter.
    """
    each = _ruled(docs.select(key, text), toxic, p, text, key, free_name(docs, "pieces"))
    return each.select(key, F.explode(free_name(docs, "pieces")).alias("x")).select(key, "x.pos", "x.sentence", "x.rule")


def silver(docs: DataFrame, toxic: DataFrame, p: Params, *, names: Expression | None = None, text: str = "raw_text", key: str = "episode_id") -> DataFrame:
    """``docs`` without ``text`` and ``sentences``, with ``content_body, ads_removed_count, nlp_guests``.

    Kept sentences are joined by blanks; a null or empty text gives an empty one. With up to ``MOST_HASHED`` phrases nothing is
    shuffled; with more the positions of rule-3 sentences are, and the texts once to meet them.
    """
    find = names or capitalised_names(p.lexicons.blocked_names, p.max_guests)
    made = free_name(docs, "pieces")
    full = _ruled(docs, toxic, p, text, key, made)
    body = F.array_join(F.transform(F.filter(made, lambda x: x["rule"] == 0), lambda x: x["sentence"]), " ")
    dropped = F.size(F.filter(made, lambda x: x["rule"] > 0)).cast("long")
    out = full.withColumns({"content_body": body, "ads_removed_count": dropped})
    return out.withColumn("nlp_guests", find(t.prefix(F.col("content_body"), p.name_chars))).drop(text, "sentences", made)
