"""Concepts of several words.

Candidates are runs of two to four words inside a sentence that neither begin nor end with
a stop word. A candidate's C-value is its frequency less the mean frequency of the longer
candidates that hold it, times the logarithm of its length: "neural network" counts where it
isn't part of "deep neural network". The association of its words (normalised mutual
information) keeps out words that meet by chance.

Texts become words once. Most candidates are in too few documents, so they are numbers first:
tasks pack them, four bytes each, and what isn't in enough documents is never made text. The
rest, a few others among it, is counted by its text: a document marks each of its terms once, so
occurrences and documents are sums by term.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..plans.sizes import MOST_HASHED, small
from ..sources.shelf import Shelf
from . import grams

LENGTHS = (2, 3, 4)
#: Characters of a candidate's first and last word at least.
SHORTEST = 3
#: Bits of a number inside its part and of the part, and bits for the rows of a stretch, which has at most so many words.
LOW, PART, ROW = 32, 10, 20
#: Bytes of a word that is hashed together with others.
LONG = 256


def lines(text: Column) -> Column:
    """The lower-cased words of a text with blanks between them, a sentence a line; empty for a null one. The same words and sentences as in ``functions.text``."""
    ends = F.regexp_replace(text, rf"[.!?]{t.SPACE}+|[\n{t.MARK}]", "\n")
    told = F.regexp_replace(F.lower(ends), r"[^\p{L}\p{N}_\n]+", " ")
    return F.coalesce(F.trim(F.replace(F.replace(told, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))), F.lit(""))


def _hashed(words: pa.Array) -> np.ndarray:
    """A number for each word, made eight bytes at a time for all words at once; of a long word by itself."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.concatenate([np.frombuffer(words.buffers()[2] or b"", np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    sizes = np.diff(at)
    out = sizes.astype(np.uint64) * np.uint64(grams.FACTORS[1])
    own, done = np.flatnonzero((sizes > 0) & (sizes <= LONG)), 0
    while len(own):
        left = sizes[own] - done
        x = out[own] ^ (eight[at[own] + done] & (np.uint64(2**64 - 1) >> np.uint64(8) * np.maximum(8 - left, 0).astype(np.uint64)))
        for factor in grams.FACTORS:
            x ^= x >> np.uint64(32)
            x *= np.uint64(factor)
        out[own] = x ^ (x >> np.uint64(32))
        own, done = own[left > 8], done + 8
    for i in np.flatnonzero(sizes > LONG):
        out[i] = int.from_bytes(blake2b(data[at[i] : at[i + 1]], digest_size=8).digest(), "little")
    return out


def _laid(told: pa.Array, stop: Sequence[str]):
    """For each stretch of rows: where their words begin, where their sentences' words begin, how many sentences are before
    each row, the words, their numbers, and for each length where the candidates begin."""
    sentences = pc.split_pattern(told, "\n")
    words = pc.split_pattern(sentences.flatten(), " ")
    rows, ends = grams._offsets(sentences), grams._offsets(words)
    coded = words.flatten().dictionary_encode()
    known, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    fits = pc.and_(pc.greater_equal(pc.utf8_length(known), SHORTEST), pc.invert(pc.is_in(known, value_set=pa.array(stop, pa.string()))))
    fits, hashes = fits.to_numpy(zero_copy_only=False), _hashed(known)
    for a, b in grams._stretches(ends[rows]):
        at, own = rows[a : b + 1] - rows[a], ends[rows[a] : rows[b] + 1]
        code = ids[own[0] : own[-1]]
        own = own - own[0]
        fit = fits[code]
        begins = [grams._starts(own, n)[0] for n in LENGTHS]
        yield own[at], own, at, pa.DictionaryArray.from_arrays(pa.array(code), known), hashes[code], [x[fit[x] & fit[x + n - 1]] for n, x in zip(LENGTHS, begins)]


def _row_of(at: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def _often(docs: DataFrame, words: str, least: int, stop: Sequence[str]) -> DataFrame:
    """``number`` of the candidates that may be in at least ``least`` rows: all of those, and what shares a number with others.

    A stretch of rows sends a number ``least`` times at most, so a part stays near even whatever is frequent.
    """

    def packed(batches):
        for batch in batches:
            for at, _, _, _, h, begins in _laid(batch.column(0), stop):
                row = _row_of(at).astype(np.uint64)  # each row has a word, if an empty one, so the rows fit the bits
                key = [(grams._numbers(h, n, grams.FACTORS[0])[x] & np.uint64((1 << LOW + PART) - 1)) << np.uint64(ROW) | row[x] for n, x in zip(LENGTHS, begins)]
                key = np.sort(np.concatenate(key))
                key = key[np.concatenate([[True], key[1:] != key[:-1]])] >> np.uint64(ROW) if len(key) else key
                key = key[np.concatenate([np.ones(min(least, len(key)), bool), key[least:] != key[:-least]])]
                part = (key >> np.uint64(LOW)).astype(np.int32)
                cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(key) else np.zeros(0, np.int64)
                sent = [pa.py_buffer((4 * np.append(cuts, len(key))).astype(np.int32)), pa.py_buffer(key.astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.Array.from_buffers(pa.binary(), len(cuts), [None, *sent])], ["part", "packed"])

    def counted(table: pa.Table) -> pa.Table:
        h = np.sort(np.frombuffer(b"".join(table.column("packed").to_pylist()), np.uint32))
        last = h[least - 1 :]
        found = np.unique(last[last == h[: len(last)]]).astype(np.int64)
        return pa.table({"number": found | table.column("part")[0].as_py() << LOW})

    return docs.select(words).mapInArrow(packed, "part int, packed binary").groupBy("part").applyInArrow(counted, "number long")


def _texts(words: pa.DictionaryArray, begins: np.ndarray, n: int) -> pa.Array:
    return pc.binary_join_element_wise(*(words.dictionary.take(words.indices.take(pa.array(begins + j))) for j in range(n)), " ")


def _counted(docs: DataFrame, words: str, stop: Sequence[str], bits: np.ndarray) -> DataFrame:
    """``term, n, f, df`` of the candidates that pass a filter, and of all words, with ``n`` 1 and no ``df``.

    A stretch of rows adds up its own before they are text, where two numbers tell them apart.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def made(batches):
        for batch in batches:
            for at, _, _, told, h, begins in _laid(batch.column(0), stop):
                row, uses = _row_of(at), np.bincount(told.indices.to_numpy(), minlength=len(told.dictionary))
                code = np.flatnonzero(uses)
                yield pa.RecordBatch.from_arrays([told.dictionary.take(pa.array(code)), pa.array(np.ones(len(code), np.int32)), pa.array(uses[code]), pa.array(0 * code)], ["term", "n", "f", "df"])
                for n, x in zip(LENGTHS, begins):
                    first = grams._numbers(h, n, grams.FACTORS[0])[x]
                    good = grams.maybe(sent.value, first)
                    x, first = x[good], first[good]
                    second = grams._numbers(h, n, grams.FACTORS[1])[x]
                    order = np.lexsort((second, first))  # stable, so a term's rows stay in order
                    x, first, second = x[order], first[order], second[order]
                    own = np.ones(len(x), bool)
                    own[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
                    starts, rows = np.flatnonzero(own), own.copy()
                    rows[1:] |= row[x[1:]] != row[x[:-1]]
                    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(rows)])
                    f, df = np.diff(np.append(starts, len(x))), np.diff(sums[np.append(starts, len(x))])
                    yield pa.RecordBatch.from_arrays([_texts(told, x[starts], n), pa.array(np.full(len(f), n, np.int32)), pa.array(f), pa.array(df)], ["term", "n", "f", "df"])

    each = docs.select(words).mapInArrow(made, "term string, n int, f long, df long").where("term <> ''")
    return each.groupBy("term", "n").agg(F.sum("f").alias("f"), F.sum("df").alias("df"))


def _numbered(terms: DataFrame) -> DataFrame:
    """``n, number, other`` of the terms that a text can have."""

    def made(batches):
        for batch in batches:
            for at, _, _, _, h, begins in _laid(batch.column(0), ()):
                row, sizes = _row_of(at), np.diff(at)
                for n, x in zip(LENGTHS, begins):
                    x = x[sizes[row[x]] == n]
                    columns = [grams._numbers(h, n, f)[x].view(np.int64) for f in grams.FACTORS]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), n, np.int32)), *map(pa.array, columns)], ["n", "number", "other"])

    return terms.where("term IS NOT NULL").select("term").mapInArrow(made, "n int, number long, other long")


def _found(docs: DataFrame, words: str, stop: Sequence[str], chosen: Callable, by) -> Column:
    """An array of ``term, at`` for each candidate of a text that ``chosen(by, n, h, g)`` takes by its two numbers; equal ones side by side.

    ``at`` orders candidates by sentence, by first word and the longer one first: one long, since a text has less than 2^31 bytes.
    """
    sent = docs.sparkSession.sparkContext.broadcast(by)
    kind = pa.struct([("term", pa.string()), ("at", pa.int64())])

    @F.arrow_udf("array<struct<term:string,at:bigint>>")
    def made(told: pa.Array) -> pa.Array:
        sizes, parts = [], []
        for at, own, before, words, h, begins in _laid(told, stop):
            terms, numbers = [], []
            for i, (n, x) in enumerate(zip(LENGTHS, begins)):
                both = [grams._numbers(h, n, f)[x] for f in grams.FACTORS]
                good = chosen(sent.value, n, *both)
                begins[i] = x = x[good]
                numbers.append([y[good] for y in both])
                terms.append(_texts(words, x, n))
            begin, n = np.concatenate(begins), np.repeat(LENGTHS, [len(x) for x in begins])
            row = _row_of(at)[begin]
            sentence = np.repeat(np.arange(len(own) - 1), np.diff(own))[begin]
            order = np.lexsort((*(np.concatenate(x) for x in zip(*numbers)), row))
            place = (((sentence - before[row]) << 31 | begin - own[sentence]) << 2) + LENGTHS[-1] - n
            parts.append(pa.StructArray.from_arrays([pa.concat_arrays(terms).take(pa.array(order)), pa.array(place[order])], fields=list(kind)))
            sizes.append(np.bincount(row, minlength=len(at) - 1))
        return grams._listed(sizes, pa.concat_arrays(parts) if parts else pa.array([], kind))

    return made(words)


def _inner(terms: DataFrame, stop: Sequence[str]) -> DataFrame:
    """``term, f``: each shorter candidate inside a term, once for each such term, with the frequency of that."""

    def made(batches):
        for batch in batches:
            f, done = batch.column(1).to_numpy(), 0
            for at, _, _, told, h, begins in _laid(batch.column(0), stop):
                row, sizes = _row_of(at), np.diff(at)
                for n, x in zip(LENGTHS[:-1], begins):
                    x = x[sizes[row[x]] > n]
                    same = [grams._numbers(h, n, y)[x] for y in grams.FACTORS]
                    order = np.lexsort((*same, row[x]))
                    x, same = x[order], [y[order] for y in same]
                    own = np.ones(len(x), bool)
                    own[1:] = (row[x[1:]] != row[x[:-1]]) | (same[0][1:] != same[0][:-1]) | (same[1][1:] != same[1][:-1])
                    x = x[own]
                    yield pa.RecordBatch.from_arrays([_texts(told, x, n), pa.array(f[done + row[x]])], ["term", "f"])
                done += len(at) - 1

    return terms.select("term", "f").mapInArrow(made, "term string, f long")


def _may(bits: np.ndarray, n: int, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    return grams.maybe(bits, h)


def _known(phrases: dict[int, grams.Known], n: int, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    return phrases[n].has(h, g)


def _sent(terms: DataFrame) -> dict[int, grams.Known]:
    """The terms of each length as two numbers; sixteen bytes a term come to the driver, so ask for their number before."""
    got = _numbered(terms).toArrow()
    n, *both = (got.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("n", "number", "other"))
    return {m: grams.Known(*(x[n == m] for x in both)) for m in LENGTHS}


def _marked(terms: Column) -> Column:
    """``term, first`` of each of a document's terms in order; ``first`` is 1 once for each distinct one."""
    return F.transform(terms, lambda x, i: F.struct(x.alias("term"), (~F.get(terms, i - 1).eqNullSafe(x)).cast("long").alias("first")))


def term_table(docs: DataFrame, *, text: str = "text", least: int = 3, stop: Sequence[str] = (), words: str | None = None) -> DataFrame:
    """``term, n, f, df, holders, cvalue, association`` of the candidates in at least ``least`` documents; ``holders`` are the longer ones with it.

    Null and empty texts have no candidate. A document counts once for ``df`` however often a term occurs; repeated documents
    count each. ``words`` names a column of each text's ``lines``, if there is one.
    """
    shelf = Shelf(docs.sparkSession, "terms")
    told = docs.select(F.col(words).alias("words")) if words else shelf.put(docs.select(lines(F.col(text)).alias("words")))
    numbers = shelf.put(_often(told, "words", max(least, 1), stop))
    both = shelf.put(_counted(told, "words", stop, grams.bits_of(numbers, "number")).where((F.col("n") == 1) | (F.col("df") >= least)))
    found, counts = both.where("n > 1"), both.where("n = 1").select(F.col("term").alias("word"), F.col("f").alias("f_word"))
    shelf.drop(numbers)
    if not words:
        shelf.drop(told)
    held = _inner(found, stop).groupBy("term").agg(F.count(F.lit(1)).alias("holders"), F.sum("f").alias("held"))
    total = float(counts.agg(F.sum("f_word")).first()[0] or 1)
    own = found.select("term", F.explode(F.split("term", " ")).alias("word")).join(counts, "word").groupBy("term").agg(F.sum(F.log(F.col("f_word").cast("double"))).alias("logs"))
    joined = found.join(held, "term", "left").join(own, "term")
    f, n = F.col("f").cast("double"), F.col("n").cast("double")
    cvalue = F.log2(n) * (f - F.coalesce(F.col("held") / F.col("holders"), F.lit(0.0)))
    pmi = F.log(f) + (n - 1) * F.log(F.lit(total)) - F.col("logs")
    rarity = F.greatest(-(n - 1) * F.log(f / F.lit(total)), F.lit(1e-12))
    return joined.select("term", "n", "f", "df", F.coalesce("holders", F.lit(0).cast("long")).alias("holders"), cvalue.alias("cvalue"), (pmi / rarity).alias("association"))


def document_terms(docs: DataFrame, terms: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = 8, stop: Sequence[str] = (), words: str | None = None) -> DataFrame:
    """``key, term, count, rank``: a document's ``k`` most frequent terms, ties by first place, the longer one first there.

    ``words`` names a column of each text's ``lines``, if there is one. Up to ``MOST_HASHED`` terms are sent to the tasks
    as numbers; beyond that the candidates that pass a filter of their numbers meet them in a join.
    """
    told = docs.select(key, (F.col(words) if words else lines(F.col(text))).alias("words"))
    if small(terms, MOST_HASHED):
        found = _found(told, "words", stop, _known, _sent(terms))
        own = told.select(key, F.explode(found).alias("x")).select(key, "x.term", "x.at")
    else:
        numbers = Shelf(docs.sparkSession, "terms").put(_numbered(terms))
        found = _found(told, "words", stop, _may, grams.bits_of(numbers, "number"))
        own = told.select(key, F.explode(found).alias("x")).select(key, "x.term", "x.at").join(terms.select("term").hint("merge"), "term", "left_semi")
    by = own.groupBy(key, "term").agg(F.count(F.lit(1)).alias("count"), F.min("at").alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("count"), "first"))
    return by.withColumn("rank", rank).where(F.col("rank") <= k).select(key, "term", "count", "rank")
