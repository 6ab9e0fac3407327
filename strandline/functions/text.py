"""Text primitives as column expressions; all stay in the JVM."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
MARK = "\u0001"
#: White space of Unicode, as a class that Java and other engines read alike.
SPACE = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: The same characters.
SPACES = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row, however often the body or a lambda in it uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix(text: Column, n: int | None) -> Column:
    """The first ``n`` characters, or all."""
    return text if n is None else F.substring(text, 1, n)


def strip(text: Column) -> Column:
    """Without white space of any script at either end, not only blanks."""
    return F.btrim(text, F.lit(SPACES))


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` before white space, and at line ends."""
    return F.split(F.regexp_replace(text, rf"([.!?]){SPACE}+|\n", "$1" + MARK), MARK)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens joined by blanks; fewer tokens give none."""

    def runs(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))

    return let(tokens, runs)


def without_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", "")


def contains_any(text: Column, phrases) -> Column:
    """Whether one of the phrases occurs; without phrases false."""
    return reduce(or_, (F.contains(text, F.lit(p)) for p in phrases), F.lit(False))


def starts_with_any(text: Column, starts) -> Column:
    return reduce(or_, (F.startswith(text, F.lit(p)) for p in starts), F.lit(False))


def occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of a phrase, case as it stands."""
    return F.regexp_count(text, F.lit(re.escape(phrase)))


def phrase_hits(text: Column, phrases) -> Column:
    """Occurrences of all phrases in the lower-cased text, each counted by itself."""
    low = F.lower(text)
    return sum((occurrences(low, p) for p in phrases), F.lit(0)).cast("long")


def safe_phrase(phrase: Column, keywords, starters) -> Column:
    """A keyword makes a phrase unsafe; else a safe starter makes it safe."""
    return F.when(contains_any(phrase, keywords), False).otherwise(starts_with_any(phrase, starters))


def preview(text: Column, n: int = 100) -> Column:
    return F.concat(F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit(" ")), F.lit("..."))


def without_fences(text: Column) -> Column:
    """Without Markdown code fences, stripped."""
    return strip(F.regexp_replace(text, "```(?:cypher|sql)?", ""))


def fact(names: list[str]) -> Column:
    """``k: v | k: v`` of the named columns."""
    return F.concat_ws(" | ", *(F.concat(F.lit(f"{n}: "), F.coalesce(F.col(n).cast("string"), F.lit("None"))) for n in names))
