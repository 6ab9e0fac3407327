"""What a model would supply, behind small interfaces, with deterministic defaults.

The defaults are stand-ins so that every plan runs without a model. They aren't
equivalent to any model.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t


class Expression(Protocol):
    """An array or a number from a text column."""

    def __call__(self, text: Column) -> Column: ...


def capitalised_names(blocked: Sequence[str], most: int) -> Expression:
    """Runs of two capitalised words, longer than three characters, not blocked, the first ``most`` distinct ones."""

    def find(text: Column) -> Column:
        names = F.regexp_extract_all(text, F.lit(r"\p{Lu}[\p{Ll}]+ \p{Lu}[\p{Ll}]+"), F.lit(0))
        good = F.filter(names, lambda n: (F.length(n) > 3) & ~F.lower(n).isin(*blocked))
        return F.slice(F.array_distinct(good), 1, most)

    return find


def frequent_words(shorter: int, stop: Sequence[str]) -> Expression:
    """All lower-cased words longer than ``shorter`` characters, in order, as concepts."""
    return lambda text: F.filter(t.words(text), lambda w: (F.length(w) > shorter) & ~w.isin(*stop))


def lexicon_sentiment(scores: dict[str, float]) -> Expression:
    """Mean score of the words that the lexicon has; 0 without one."""
    table = F.create_map(*(F.lit(x) for pair in scores.items() for x in pair)) if scores else None

    def find(text: Column) -> Column:
        if table is None:
            return F.lit(0.0)
        hits = F.filter(F.transform(t.words(text), lambda w: F.try_element_at(table, w)), lambda x: x.isNotNull())
        return F.when(F.size(hits) > 0, F.aggregate(hits, F.lit(0.0), lambda a, x: a + x) / F.size(hits)).otherwise(0.0)

    return find


def hashed_embedding(dim: int = 64) -> Expression:
    """Signed counts of hashed words in ``dim`` places, scaled to length 1. The words are sorted by place once."""

    def embed(text: Column) -> Column:
        h = F.transform(t.words(text), lambda w: F.xxhash64(w))
        code = lambda x: F.pmod(x, F.lit(dim)) * 2 + F.pmod(F.shiftright(x, 32), F.lit(2))

        def counted(rows: Column) -> Column:
            n = F.size(rows)
            places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
            starts = F.filter(places, lambda i: (i == 1) | (F.element_at(rows, i) != F.element_at(rows, F.greatest(i - 1, F.lit(1)))))
            runs = lambda at: F.transform(at, lambda i, k: F.struct(F.element_at(rows, i).alias("code"), (F.coalesce(F.get(at, k + 1), n + 1) - i).alias("n")))
            return t.let(starts, runs)

        def summed(runs: Column) -> Column:
            own = lambda i, sign: F.aggregate(F.filter(runs, lambda x: x["code"] == i * 2 + sign), F.lit(0.0), lambda a, x: a + x["n"])
            return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: own(i, 0) - own(i, 1))

        def scaled(counts: Column) -> Column:
            length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x))
            return t.let(length, lambda size: F.transform(counts, lambda x: F.when(size > 0, x / size).otherwise(0.0).cast("float")))

        return t.let(t.let(t.let(F.array_sort(F.transform(h, code)), counted), summed), scaled)

    return embed


class Chat(Protocol):
    """A language model. ``task`` is ``grade`` (is the context of use for the question, yes or no), ``rewrite`` (a better question) or ``answer``."""

    def __call__(self, task: str, question: str, context: list[dict], history: list[dict]) -> str: ...


class ExtractiveChat:
    """Grades by shared words, rewrites by dropping short words, answers with the first context text."""

    def __call__(self, task: str, question: str, context: list[dict], history: list[dict]) -> str:
        if task == "grade":
            known = set().union(*(self._words(str(c.get("text") or "")) for c in context)) if context else set()
            return "YES" if known & self._words(question) else "NO"
        if task == "rewrite":
            return " ".join(w for w in question.split() if len(w) > 3) or question
        return context[0]["text"] if context else "I don't know."

    @staticmethod
    def _words(x: str) -> set[str]:
        return {w for w in re.findall(r"\w+", x.lower()) if len(w) > 3}


#: What a model is told for a task that isn't an answer; own wording, to be replaced at will.
TASKS = {
    "grade": "You judge search results. Reply with one word: YES if they help with the question, else NO.",
    "rewrite": "You improve search queries. Reply with the improved query and nothing else.",
}


def prompted(send: Callable[[list[dict]], str], persona: str, turns: int = 4, shown: int = 500) -> Chat:
    """A ``Chat`` from a function that takes messages; a grade sees ``shown`` characters of the context."""

    def chat(task: str, question: str, context: list[dict], history: list[dict]) -> str:
        asked = f"Results: {str(context)[:shown]}\nQuestion: {question}" if task == "grade" else question
        return send(messages(asked, context, history, persona, TASKS.get(task), turns))

    return chat


def safe(call: Callable[[], str]) -> str:
    """Errors of a model come back as text."""
    try:
        return call()
    except Exception as e:
        return f"[model error: {e}]"


def messages(query: str, context: list[dict], history: list[dict], persona: str, override: str | None = None, turns: int = 4) -> list[dict]:
    """The messages for a chat model: the persona with the context, or the override alone; the last turns only with the persona."""
    if override:
        return [{"role": "system", "content": override}, {"role": "user", "content": query}]
    lines = "".join(f"- [{c.get('chunk_id') or 'Unknown'}]: {c.get('text') or c.get('text_content') or ''}\n" for c in context)
    return [{"role": "system", "content": f"{persona}\n\nContext:\n{lines}"}, *({"role": m["role"], "content": m["content"]} for m in history[-turns:]), {"role": "user", "content": query}]
