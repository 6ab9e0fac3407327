"""Names by letter case.

A word is a name word if it is nearly always capitalised where no sentence starts. Where
it starts one says nothing, so these places aren't counted. Names are runs of name words,
at most four, and known names of a table before them, the longest first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.members import members

WORD = r"\p{L}[\p{L}'-]*"
CAPITAL = r"\p{Lu}[\p{L}'-]*"
#: Words of a name at most; times and share that a name word is capitalised inside sentences.
LONGEST, LEAST, SHARE = 4, 3, 0.9


def case_counts(docs: DataFrame, *, text: str = "text", split: Callable[[Column], Column] = t.sentences) -> DataFrame:
    """``word, capital, small``: how often each lower-cased word is capitalised, not counting starts of sentences, and how often it isn't."""
    words = F.transform(split(F.col(text)), lambda s: F.regexp_extract_all(s, F.lit(WORD), F.lit(0)))
    told = F.flatten(F.transform(words, lambda w: F.transform(w, lambda x, i: F.struct(x.alias("word"), (i == 0).alias("first")))))
    each = docs.select(F.explode(told).alias("x")).select("x.*").withColumn("upper", F.regexp_like("word", F.lit(r"^\p{Lu}")))
    one = lambda c: F.sum(c.cast("long"))
    return each.groupBy(F.lower("word").alias("word")).agg(one(F.col("upper") & ~F.col("first")).alias("capital"), one(~F.col("upper")).alias("small"))


def name_words(counts: DataFrame, *, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """The words of ``case_counts`` that are names."""
    return counts.where((F.col("capital") >= least) & (F.col("capital") >= F.lit(share) * (F.col("capital") + F.col("small"))))


def _runs(text: Column) -> Column:
    """Runs of capitalised words with one blank between them."""
    return F.regexp_extract_all(text, F.lit(rf"{CAPITAL}(?: {CAPITAL})*"), F.lit(0))


def _stretches(run: Column, known: Callable[[Column], Column], is_word: Callable[[Column], Column]) -> Column:
    """The names of a run, from the left: a known one, the longest first, or as many name words as stand together."""
    kind = "array<string>"

    def fold(words: Column) -> Column:
        def here(i: Column, n: int) -> Column:
            return F.array_join(F.slice(words, i + 1, n), " ")

        def step(a: Column, i: Column) -> Column:
            length = F.coalesce(*(F.when((i + n <= F.size(words)) & known(F.lower(here(i, n))), F.lit(n)) for n in range(LONGEST, 0, -1)), F.lit(0))
            word = F.get(words, i)
            closed = F.when(F.size(a["open"]) > 0, F.array_append(a["done"], F.array_join(a["open"], " "))).otherwise(a["done"])
            state = lambda skip, open_, done: F.struct(skip.cast("int").alias("skip"), open_.cast(kind).alias("open"), done.cast(kind).alias("done"))
            full = F.array_append(a["done"], F.array_join(F.array_append(a["open"], word), " "))
            grown = F.when(F.size(a["open"]) == LONGEST - 1, state(F.lit(0), F.array(), full)).otherwise(state(F.lit(0), F.array_append(a["open"], word), a["done"]))
            found = state(length - 1, F.array(), F.array_append(closed, F.element_at(F.array(*(here(i, n) for n in range(1, LONGEST + 1))), F.greatest(length, F.lit(1)))))
            return F.when(a["skip"] > 0, state(a["skip"] - 1, a["open"], a["done"])).when(length > 0, found).when(is_word(F.lower(word)), grown).otherwise(state(F.lit(0), F.array(), closed))

        start = F.struct(F.lit(0).alias("skip"), F.array().cast(kind).alias("open"), F.array().cast(kind).alias("done"))
        last = F.aggregate(F.sequence(F.lit(0), F.size(words) - 1), start, step)
        return t.let(last, lambda a: F.when(F.size(a["open"]) > 0, F.array_append(a["done"], F.array_join(a["open"], " "))).otherwise(a["done"]))

    return t.let(F.split(run, " "), fold)


def with_names(docs: DataFrame, words: DataFrame, *, known: DataFrame | None = None, text: str = "text", out: str = "names", most: int | None = None) -> DataFrame:
    """``docs`` with ``out``: the distinct names of a text in order of their first place, the first ``most`` or all.

    ``words`` are the name words (``word``), ``known`` names of a table (``name``), both looked up whatever the case, beside a
    size check. A null text has null, one without a name an empty array.
    """
    runs = _runs(F.col(text))
    single = F.transform(F.regexp_extract_all(F.col(text), F.lit(CAPITAL), F.lit(0)), lambda w: F.lower(w))
    each, is_word = members(docs, words, "word", text, single, "name words of the text")
    is_known: Callable[[Column], Column] = lambda w: F.lit(False)
    if known is not None:
        grams = F.flatten(F.transform(runs, lambda r: F.flatten(F.array(*(t.ngrams(F.split(F.lower(r), " "), n) for n in range(1, LONGEST + 1))))))
        each, is_known = members(each, known.select(F.lower("name").alias("name")), "name", text, grams, "known names of the text")
    found = F.array_distinct(F.flatten(F.transform(runs, lambda r: _stretches(r, is_known, is_word))))
    found = found if most is None else F.slice(found, 1, most)
    return each.withColumn(out, found).drop("name words of the text", "known names of the text")
