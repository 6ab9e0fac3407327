"""Occurrences of the phrases of a large lexicon.

A few phrases are a chain of ``contains`` in the plan (``functions.text``); a lexicon is
an automaton that reads a text once, whatever the number of phrases. It travels to the
tasks under a size check: a lexicon of more than ``MOST`` characters is dealt into parts by
hash, and each part reads the texts once. Phrases are found as characters, inside words too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the phrases that one automaton holds (about 100 bytes each in a worker).
MOST = 2_000_000

_ready: dict[tuple, ahocorasick.Automaton] = {}


def _automaton(name: tuple, phrases: list[str]) -> ahocorasick.Automaton:
    """This worker's automaton, made once."""
    if name not in _ready:
        _ready.clear()
        made = ahocorasick.Automaton()
        for i, p in enumerate(phrases):
            made.add_word(p, i)
        made.make_automaton()
        _ready[name] = made
    return _ready[name]


def counted(automaton: ahocorasick.Automaton, phrases: list[str], text: str) -> dict[int, int]:
    """Each phrase's occurrences, those of one phrase not overlapping, from the left."""
    n: dict[int, int] = {}
    free: dict[int, int] = {}
    for end, i in automaton.iter(text):
        start = end + 1 - len(phrases[i])
        if start >= free.get(i, 0):
            n[i], free[i] = n.get(i, 0) + 1, end + 1
    return n


def hits(docs: DataFrame, lexicon: DataFrame, *, key: str = "doc_id", text: str = "text", phrase: str = "phrase", most: int = MOST) -> DataFrame:
    """``key, phrase, n``: a row for each document and phrase of the lexicon that occurs in its text, letters as they stand.

    Null and empty phrases, null texts and empty ones have no row; repeated phrases are one, repeated documents have rows each.
    The lexicon comes to the driver part by part, never whole beyond ``most`` characters; texts aren't shuffled.
    """
    spark = docs.sparkSession
    own = lexicon.select(F.col(phrase).alias("phrase")).where("phrase IS NOT NULL AND phrase <> ''").distinct()
    size = own.agg(F.sum(F.length("phrase"))).first()[0] or 0
    parts = max(1, math.ceil(size / most))
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("body")).where("body IS NOT NULL AND body <> ''")
    schema = f"key {source.schema['key'].dataType.simpleString()}, phrase string, n long"
    out = None
    for part in range(parts):
        found = own if parts == 1 else own.where(F.pmod(F.xxhash64("phrase"), F.lit(parts)) == part)
        phrases = sorted(r.phrase for r in found.collect())
        if phrases:
            each = source.mapInArrow(_reader(phrases, (spark.sparkContext.applicationId, hash(tuple(phrases)), part)), schema)
            out = each if out is None else out.union(each)
    out = spark.createDataFrame([], schema) if out is None else out
    return out.withColumnRenamed("key", key)


def _reader(phrases: list[str], name: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(name, phrases)
        for batch in batches:
            at: list[int] = []
            which: list[int] = []
            times: list[int] = []
            for row, body in enumerate(batch.column(1).to_pylist()):
                n = counted(automaton, phrases, body)
                at.extend([row] * len(n))
                which.extend(n)
                times.extend(n.values())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([phrases[i] for i in which], pa.string()), pa.array(times, pa.int64())], names=["key", "phrase", "n"])

    return run


def with_any(docs: DataFrame, lexicon: DataFrame, *, key: str = "doc_id", **how) -> DataFrame:
    """The documents with a phrase of the lexicon: ``contains_any`` for lexicons too large for a plan."""
    found = hits(docs, lexicon, key=key, **how).select(F.col(key).alias("hit")).distinct()
    return docs.join(found, F.col(key).eqNullSafe(F.col("hit")), "left_semi")


def occurrences(docs: DataFrame, lexicon: DataFrame, *, key: str = "doc_id", out: str = "hits", **how) -> DataFrame:
    """``key, out``: how often phrases occur in a document, summed over all of them; documents without any aren't in it."""
    return hits(docs, lexicon, key=key, **how).groupBy(key).agg(F.sum("n").alias(out))
