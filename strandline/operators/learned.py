"""Vectors learned from the corpus itself.

Words that occur in a share of the documents are the vocabulary, so its size is bounded by
the mean number of words of a document over that share, whatever the corpus holds. Pairs of
them within a window are counted, their positive mutual information is a sparse symmetric
matrix, and the leading part of it is found by a randomised range finder: a few passes over
the pairs, each multiplying them with a tall and narrow matrix that travels to the tasks. A
text is the mean of its words' vectors, frequent words counting less, without
the direction that all texts share. Queries and chunks pass through the same function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..sources.files import table as scanned
from ..sources.shelf import Shelf


@dataclass(frozen=True)
class Learning:
    """A word is in at least ``share`` of the documents and ``least`` of them; pairs are within ``window`` words.

    ``size`` numbers a vector, ``more`` columns of the range finder beside them, ``rounds`` multiplications to sharpen it.
    ``weight``: the frequency at which a word counts half. ``most`` words is the bound of what is sent; beyond it
    ``fit`` stops and asks for a larger share.
    """

    share: float = 0.002
    least: int = 3
    window: int = 4
    size: int = 64
    more: int = 16
    rounds: int = 3
    weight: float = 1e-3
    most: int = 200_000
    seed: int = 7


#: Pairs that a task adds up before it passes them on.
HELD = 1_000_000
#: Words that a task looks at once, and those whose vectors it holds at once.
WORDS, WEIGHED = 1 << 17, 1 << 14


@dataclass(frozen=True)
class Embedding:
    """``words`` in order of their numbers, ``vectors`` and ``weights`` of each, and ``common``, the direction of all texts."""

    words: list[str]
    vectors: np.ndarray
    weights: np.ndarray
    common: np.ndarray

    def save(self, spark: SparkSession, path: str) -> None:
        """A row for each word, and one without a word for the common direction."""
        rows = [(w, v.tolist(), float(x)) for w, v, x in zip(self.words, self.vectors, self.weights)]
        spark.createDataFrame([*rows, (None, self.common.tolist(), 0.0)], "word string, vector array<double>, weight double").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Embedding:
        rows = scanned(spark, path).collect()  # bounded by the vocabulary
        known = sorted((r for r in rows if r.word is not None), key=lambda r: r.word)
        common = next(r.vector for r in rows if r.word is None)
        return cls([r.word for r in known], np.array([r.vector for r in known]).reshape(len(known), len(common)), np.array([r.weight for r in known]), np.array(common))


def vocabulary(docs: DataFrame, how: Learning = Learning(), *, text: str = "text") -> DataFrame:
    """``word, df``: words of enough documents."""
    n = docs.count()
    each = docs.select(F.explode(F.array_distinct(t.words(F.col(text)))).alias("word"))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= max(how.least, how.share * n))


def _counts(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _slices(lists: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """The first row and the rows of parts with at most ``most`` words, or one row of more."""
    ends, begin = np.cumsum(_counts(lists)), 0
    while begin < len(lists):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most, "right")))
        yield begin, lists.slice(begin, end - begin)
        begin = end


def _numbers(lists: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each word, -1 for others, and the row of each."""
    counts = _counts(lists)
    ids = pc.fill_null(pc.index_in(lists.flatten(), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, np.repeat(np.arange(len(counts)), counts)


def pair_counts(docs: DataFrame, words: list[str], how: Learning = Learning(), *, text: str = "text") -> DataFrame:
    """``a, b, n``: how often two words, by number, stand within the window, in either order; each task adds up its own first."""
    spread = docs.sparkSession.sparkContext.broadcast(pa.array(words, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            return keys[begin], np.add.reduceat(n, begin) if len(keys) else n

        def out(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(n.astype(np.int64))], names=["a", "b", "n"])

        for batch in batches:
            for _, part in _slices(batch.column(0), WORDS):
                ids, rows = _numbers(part, spread.value)
                for step in range(1, how.window + 1):
                    a, b = ids[:-step], ids[step:]
                    ok = (a >= 0) & (b >= 0) & (rows[:-step] == rows[step:])
                    a, b = a[ok], b[ok]
                    keys, n = np.unique(np.concatenate([a << 32 | b, b << 32 | a]), return_counts=True)
                    held.append((keys, n))
                if sum(len(k) for k, _ in held) > HELD:
                    held = [added()]
                    if len(held[0][0]) > HELD // 2:
                        yield out(*held.pop())
        if held:
            yield out(*added())

    each = docs.select(t.words(F.col(text)).alias("words")).mapInArrow(run, "a long, b long, n long")
    return each.groupBy("a", "b").agg(F.sum("n").alias("n"))


def mutual_information(pairs: DataFrame) -> DataFrame:
    """``a, b, m``: the positive pointwise mutual information of the pairs that have any."""
    sums = pairs.groupBy("a").agg(F.sum("n").alias("s"))  # a row a word
    total = pairs.agg(F.sum("n")).first()[0] or 1
    of = lambda c: F.broadcast(sums.select(F.col("a").alias(c), F.col("s").alias(f"s_{c}")))
    m = F.log(F.col("n").cast("double") * F.lit(float(total)) / (F.col("s_a").cast("double") * F.col("s_b")))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", m.alias("m")).where("m > 0")


def multiplied(entries: DataFrame, x: np.ndarray) -> np.ndarray:
    """The matrix of the entries times ``x``: a task gives a row for each of its words, and there are few."""
    spread = entries.sparkSession.sparkContext.broadcast(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, total = spread.value, None
        seen = np.zeros(len(right), bool)
        for batch in batches:
            a, b, m = (batch.column(i).to_numpy() for i in range(3))
            total = np.zeros_like(right) if total is None else total
            order = np.argsort(a, kind="stable")
            a, b, m = a[order], b[order], m[order]
            begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
            if len(begin):
                total[a[begin]] += np.add.reduceat(right[b] * m[:, None], begin, axis=0)
                seen[a[begin]] = True
        if total is not None and seen.any():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["a", "y"])

    out = np.zeros_like(x)
    got = entries.mapInArrow(run, "a long, y array<double>").toArrow()
    if got.num_rows:
        np.add.at(out, got.column("a").to_numpy(), got.column("y").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1))
    spread.destroy()
    return out


def leading(entries: DataFrame, n: int, how: Learning = Learning()) -> np.ndarray:
    """The rows' vectors: leading eigenvectors of the symmetric matrix, each times the root of its eigenvalue's size."""
    columns = min(n, how.size + how.more)
    x = np.random.default_rng(how.seed).standard_normal((n, columns))
    q = np.linalg.qr(multiplied(entries, x))[0]
    for _ in range(how.rounds - 1):
        q = np.linalg.qr(multiplied(entries, q))[0]
    small = q.T @ multiplied(entries, q)
    e, u = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(e), kind="stable")[: how.size]
    vectors = q @ u[:, order] * np.sqrt(np.abs(e[order]))
    most = np.abs(vectors).argmax(0) if n else np.zeros(0, int)
    vectors = vectors * np.where(vectors[most, np.arange(vectors.shape[1])] < 0, -1, 1) if n else vectors
    return np.pad(vectors, ((0, 0), (0, how.size - vectors.shape[1])))


def fit(docs: DataFrame, how: Learning = Learning(), *, text: str = "text") -> Embedding:
    """Learn from the texts of all documents. A null or empty text adds nothing; without a frequent word all vectors are zero."""
    shelf = Shelf(docs.sparkSession, "learned")
    found = vocabulary(docs, how, text=text)
    known = sorted(found.limit(how.most + 1).collect(), key=lambda r: r.word)
    if len(known) > how.most:
        raise ValueError(f"more than {how.most} words are in {how.share:.2%} of the documents: ask for a larger share")
    words = [r.word for r in known]
    pairs = shelf.put(pair_counts(docs, words, how, text=text))
    entries = shelf.put(mutual_information(pairs).repartition("a"))
    vectors = leading(entries, len(words), how)
    own = F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in words], "word string"))
    seen = docs.select(F.explode(t.words(F.col(text))).alias("word")).join(own, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    times = {r.word: r.n for r in seen.collect()}
    every = docs.select(F.sum(t.word_count(F.col(text)))).first()[0] or 1
    weights = np.array([how.weight / (how.weight + times[w] / every) for w in words])
    plain = Embedding(words, vectors, weights, np.zeros(how.size))
    return Embedding(words, vectors, weights, _common(docs, plain, text))


def _means(lists: pa.Array, words: pa.Array, e: Embedding) -> np.ndarray:
    """The weighted mean of each row's vectors; a few words' vectors are held at once, of however long a row."""
    out, known = np.zeros((len(lists), e.vectors.shape[1])), np.zeros(len(lists), np.int64)
    for start, part in _slices(lists, WORDS):
        ids, rows = _numbers(part, words)
        rows, ids = rows[ids >= 0] + start, ids[ids >= 0]
        known += np.bincount(rows, minlength=len(lists))
        for i in range(0, len(ids), WEIGHED):
            at, row = ids[i : i + WEIGHED], rows[i : i + WEIGHED]
            begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            out[row[begin]] += np.add.reduceat(e.vectors[at] * e.weights[at][:, None], begin, axis=0)
    return out / np.maximum(known, 1)[:, None]


def _common(docs: DataFrame, e: Embedding, text: str) -> np.ndarray:
    """The first direction of all texts' vectors, from the sums of their products."""
    size = e.vectors.shape[1]
    spread = docs.sparkSession.sparkContext.broadcast((e, pa.array(e.words, pa.string())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            v = _means(batch.column(0), spread.value[1], spread.value[0])
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], names=["cell", "v"])

    cells = docs.select(t.words(F.col(text)).alias("words")).mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    gram = np.zeros(size * size)
    for r in cells:
        gram[r.cell] = r.v
    if not gram.any():
        return np.zeros(size)
    u = np.linalg.eigh(gram.reshape(size, size))[1][:, -1]
    return u * (-1 if u[np.abs(u).argmax()] < 0 else 1)


def embedded(texts: DataFrame, e: Embedding, *, text: str = "text_content", out: str = "vector") -> DataFrame:
    """``texts`` with ``out``, of length 1; the zero vector for a null text and one without a known word."""
    spread = texts.sparkSession.sparkContext.broadcast((e, pa.array(e.words, pa.string())))
    kept = [c for c in texts.columns if c.lower() != out.lower()]
    schema = T.StructType([*(texts.schema[c] for c in kept), T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words_ = spread.value
        for batch in batches:
            v = _means(batch.column(batch.num_columns - 1), words_, own)
            v -= (v @ own.common)[:, None] * own.common
            length = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.where(length > 1e-12, v / np.where(length > 1e-12, length, 1), 0).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], flat], names=[*kept, out])

    words = F.coalesce(t.words(F.col(text)), F.array().cast("array<string>"))
    return texts.select(*kept, words.alias("words of the text")).mapInArrow(run, schema)
