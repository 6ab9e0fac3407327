"""Toxicity: a convolutional classifier over hashed words, with thresholds by language.

Words are runs of letters, digits and other non-ASCII bytes, lower-cased. A word
and its prefixes of four to six bytes are hashed into an embedding table each, so
an unseen ending is no new word and a chance collision in one table is a quarter
of the evidence. Filters of width one to three and max pooling feed
two heads: toxic or not, and the language, which serves only to choose the
threshold. The nets are trained in tasks, one for each try, on a bounded sample.
Thresholds are calibrated on all labelled rows that training leaves out, by counts
of their raw scores, for each language that the second head names; scores are
stretched so that every language's threshold falls on 0.7. Nothing but the text
enters a score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import LOWER, hashes, slices, spans
from .convnet import TextConv, softmax
from .shelf import free_name, lean, text_batches

NOT_WORD = np.ones(256, bool)
NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
THRESHOLD = 0.7
#: Words of a text that are convolved at a time when it is scored.
LONG = 1 << 17


@dataclass(frozen=True)
class Fit:
    """At most ``documents`` labelled rows, whole texts of any length, are learned from, those whose ids hash lowest; fewer if
    they have more than ``documents * words`` words in all. One of ``hold`` is left out of training. The rows left out
    and all labelled rows beyond the sample calibrate the thresholds and pick the best of ``tries`` nets, by counts in ``bins``
    of the raw score; a language needs ``least`` toxic ones of them for a threshold of its own. An embedding row is kept
    if at least ``seen`` learned texts use it. Up to ``sent`` labelled ids are sent to the tasks that score for calibration, to
    leave out other rows early; with more, all rows are scored there."""

    documents: int = 10_000
    words: int = 1_500
    hold: int = 5
    seen: int = 3
    bits: int = 17
    dim: int = 8
    filters: int = 16
    steps: int = 1_000
    tries: int = 2
    bins: int = 4096
    least: int = 8
    sent: int = 1 << 20


def remainder(key: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % by


def draw(key: Column) -> Column:
    """A number in [0, 1) that depends on the id alone; a sample takes the lowest."""
    return F.xxhash64(key, F.lit("sample")).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") / F.lit(float(1 << 53))


PREFIXES = (4, 5, 6)
TABLES = 1 + len(PREFIXES)


def _words(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The embedding rows (word, prefixes) of each word of all rows, and the words by row; Latin capitals with accents count as small ones."""
    data = LOWER[data]
    accent = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    data[accent] += 0x20
    starts, ends, counts = spans(data, offsets, NOT_WORD)
    found = hashes(data, starts, ends, *(np.minimum(starts + n, ends) for n in PREFIXES))
    return np.stack([(h >> np.uint64(64 - bits)).astype(np.int32) for h in found], -1), counts


class Model:
    """A trained net, the compact number of each embedding row that it kept, and the threshold of each language."""

    def __init__(self, net: TextConv | None, bits: int, thresholds: np.ndarray, prior: float, places: list[np.ndarray] | None = None):
        self.net, self.bits, self.thresholds, self.prior, self.places = net, bits, thresholds, prior, places

    def rows(self, words: np.ndarray) -> np.ndarray:
        """Compact numbers of embedding rows; one that wasn't kept is the padding row."""
        return words if self.places is None else np.stack([p[words[:, t]] for t, p in enumerate(self.places)], -1)

    def pooled(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Filter maxima of each row over its whole text; a text of more than ``LONG`` words in parts."""
        if (counts <= LONG).all():
            return self._short(words, counts)
        ends = np.cumsum(counts)
        each = [self._long(words[b - n : b]) if n > LONG else self._short(words[b - n : b], np.array([n]))[0] for n, b in zip(counts, ends)]
        return np.stack(each)

    def _long(self, words: np.ndarray) -> np.ndarray:
        """Maxima of one text; the words that windows at the end of a part reach into follow it."""
        net, best = self.net, None
        for a in range(0, len(words), LONG):
            part = self.rows(words[a : a + LONG + net.reach])
            n = min(LONG, len(words) - a)
            ids = np.concatenate([part, np.tile(np.array(net.rows, np.int32), (net.reach, 1))])
            e = np.concatenate([t[ids[:, i]] for i, t in enumerate(net.tables)], 1)
            found = np.concatenate([sum(e[j : j + n] @ k[j] for j in range(w)).max(0) for w, k in zip(net.widths, net.kernels)])
            best = found if best is None else np.maximum(best, found)
        return best

    def _short(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        net = self.net
        lengths = np.maximum(counts, 1)
        starts = np.concatenate([[0], np.cumsum(lengths + net.reach)])
        ids = np.empty((int(starts[-1]) + 1, TABLES), np.int32)
        ids[:] = net.rows
        words = self.rows(words)
        first = np.concatenate([[0], np.cumsum(counts)])
        ids[np.repeat(starts[:-1] - first[:-1], counts) + np.arange(len(words))] = words
        e = np.concatenate([t[ids[:, i]] for i, t in enumerate(net.tables)], 1)
        n = len(ids) - net.reach
        cuts = np.stack([starts[:-1], starts[:-1] + lengths], 1).ravel()
        out = []
        for w, k in zip(net.widths, net.kernels):
            conv = e[:n] @ k[0]
            for j in range(1, w):
                conv += e[j : j + n] @ k[j]
            out.append(np.maximum.reduceat(conv, cuts, axis=0)[::2])
        return np.concatenate(out, 1)

    def probabilities(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw probability and number of the language of each row."""
        toxic, lang = self.net.logits(self.pooled(words, counts))
        return softmax(toxic)[:, 1].astype(float), lang.argmax(1)

    def scores(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.net is None or not len(counts):
            return np.full(len(counts), self.prior)
        p, lang = self.probabilities(words, counts)
        t = self.thresholds[lang]
        return np.clip(np.where(p < t, THRESHOLD * p / t, THRESHOLD + (1 - THRESHOLD) * (p - t) / (1 - t)), 0, 1)


def best_threshold(clean: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """The probability that parts the labels with the highest F1, in the middle of its gap, and that F1.

    ``clean`` and ``toxic`` count the rows of each label in equal bins of the probability.
    """
    bins = len(clean)
    full = np.flatnonzero(clean + toxic)[::-1]
    right = np.cumsum(toxic[full])
    f1 = 2 * right / (np.cumsum((clean + toxic)[full]) + toxic.sum())
    i = int(f1.argmax())
    below = full[i + 1] + 1 if i + 1 < len(full) else 0
    return float(np.clip((full[i] + below) / 2 / bins, 0.05, 0.95)), float(f1[i])


def learn(words: list[np.ndarray], labels: np.ndarray, langs: list[str | None], how: Fit, seed: int) -> Model:
    """A net of the texts in a fixed order; ``words`` hold embedding rows by word. Thresholds are still to be calibrated."""
    names = sorted({x for x in langs if x is not None})
    number = {x: i for i, x in enumerate(names)}
    places = []
    for t in range(TABLES):  # a word that too few texts have is no evidence: it goes to the padding row
        seen = np.zeros((1 << how.bits) + 1, np.int32)
        for ids in words:
            seen[np.unique(ids[:, t])] += 1
        kept = np.flatnonzero(seen >= how.seen)
        places.append(np.full(len(seen), len(kept), np.int32))
        places[t][kept] = np.arange(len(kept), dtype=np.int32)
    model = Model(None, how.bits, np.full(max(1, len(names)), 0.5), float(labels.mean()), places)
    sample = [(model.rows(w), [int(y), number.get(x, -1)]) for w, y, x in zip(words, labels, langs)]
    toxic, clean = [s for s in sample if s[1][0]], [s for s in sample if not s[1][0]]
    chosen = clean + toxic * max(1, round(len(clean) / max(1, len(toxic)) / 3))
    model.net = TextConv([int(p.max()) for p in places], how.dim, (1, 2, 3), how.filters, [2, max(1, len(names))], seed=seed)
    model.net.train(chosen, epochs=min(30, max(2, round(how.steps * 64 / len(chosen)))), weights=[1.0, 0.3], seed=seed)
    return model


def _left_out(key: Column, how: Fit) -> Column:
    """Whether a labelled row of the sample is left out of training."""
    return F.pmod(F.xxhash64(key, F.lit("hold")), F.lit(how.hold)) == 0


def labelled_ids(labels: DataFrame, *, key: str, label: str) -> DataFrame:
    """``id, y, u`` of the labelled ids that may be learned from: label (the highest, if an id repeats) and draw."""
    chosen = labels.select(labels[key].alias("id"), labels[label].cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull() & (remainder(F.col("id"), 3) != 1))
    return chosen.groupBy("id").agg(F.max("y").alias("y")).withColumn("u", draw(F.col("id")))


def sample(docs: DataFrame, known: DataFrame, many: int, how: Fit, *, text: str, key: str, lang: str) -> tuple[DataFrame, list, float]:
    """``y, lang, u, h, words`` of the rows to train on, (label, language) of each, and the highest ``u`` of the sample.

    Rows that repeat id and text count once, so reruns choose alike. At most ``documents`` rows come to the driver, without texts.
    """
    # Only about twice the sample is sorted, however many rows and tasks there are.
    chosen = known.where(F.col("u") < 2 * how.documents / max(1, many)).orderBy("u", "id").limit(how.documents)
    given = docs.select(docs[key].alias("id"), docs[text].alias("body"), docs[lang].cast("string").alias("lang")).where(F.col("body").isNotNull())
    found = given.join(F.broadcast(chosen), "id").withColumn("h", F.xxhash64("body", "lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(3)):
                rest = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([*(rest.column(i) for i in (0, 1, 2, 4, 5)), pa.array(spans(data, offsets, NOT_WORD)[2].astype(np.int64))], names=["u", "h", "y", "lang", "hold", "n"])

    flat = found.select("u", "h", "y", "body", "lang", _left_out(F.col("id"), how).alias("hold"))
    sizes = flat.mapInArrow(lean(count), "u double, h long, y int, lang string, hold boolean, n long").dropDuplicates(["u", "h"]).orderBy("u", "h").limit(how.documents).collect()
    # Whole texts, so fewer of them if they are long.
    total = np.cumsum([r.n for r in sizes])
    sizes = sizes[: max(1, int((total <= how.documents * how.words).sum()))]
    if not sizes:
        return found.limit(0).select("y", "lang", "u", "h"), [], 2.0
    last = sizes[-1]
    inside = found.where((F.col("u") < last.u) | ((F.col("u") == last.u) & (F.col("h") <= last.h))).where(~_left_out(F.col("id"), how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(4)):
                words, _ = _words(data, offsets, how.bits)
                ends = np.concatenate([[0], np.cumsum(spans(data, offsets, NOT_WORD)[2])])
                rest = batch.slice(first, end - first)
                column = pa.array([words[ends[i] : ends[i + 1]].tobytes() for i in range(end - first)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(rest.column(i) for i in range(4)), column], names=["y", "lang", "u", "h", "words"])

    words = inside.select("y", "lang", "u", "h", "body").mapInArrow(lean(run), "y int, lang string, u double, h long, words binary").dropDuplicates(["u", "h"])
    return words, [(r.y, r.lang) for r in sizes if not r.hold], last.u


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", lang: str = "lang", how: Fit = Fit()) -> Model:
    """Learn from labelled rows whose id has not the remainder 1.

    Null ids, texts and labels teach nothing; of rows that repeat an id with its text one counts. Without both labels among
    the rows to train on (as in an empty table) the model gives every text the share of toxic ones.
    """
    text_batches(docs.sparkSession)
    known = labelled_ids(labels, key=key, label=label)
    many = known.count()
    words, marks, most = sample(docs, known, many, how, text=text, key=key, lang=lang)
    prior = float(np.mean([y for y, _ in marks])) if marks else 0.0
    if len({bool(y) for y, _ in marks}) < 2:
        return Model(None, how.bits, np.array([THRESHOLD]), min(prior, 1.0))

    def train(table: pa.Table) -> pa.Table:
        y, u, h = (table.column(c).to_numpy() for c in ("y", "u", "h"))
        order, langs = np.lexsort((h, u)), table.column("lang").to_pylist()
        texts = [np.frombuffer(x, np.int32).reshape(-1, TABLES) for x in table.column("words").to_pylist()]
        seed = table.column("seed")[0].as_py()
        model = learn([texts[i] for i in order], (y[order] > 0).astype(int), [langs[i] for i in order], how, seed)
        return pa.table({"seed": pa.array([seed], pa.int32()), "model": pa.array([pickle.dumps(model)], pa.binary())})

    seeds = F.explode(F.array(*(F.lit(i) for i in range(how.tries)))).alias("seed")
    made = words.select("*", seeds).groupBy("seed").applyInArrow(train, "seed int, model binary").collect()
    return calibrated([pickle.loads(r.model) for r in sorted(made)], docs, known, many, most, how, text=text, key=key)


def calibrated(models: list[Model], docs: DataFrame, known: DataFrame, many: int, most: float, how: Fit, *, text: str, key: str) -> Model:
    """The best of ``models``, with a threshold for each language that it names, from all labelled rows that it wasn't trained on."""
    given = docs.select(docs[key].alias("id"), docs[text].alias("body")).where(F.col("body").isNotNull() & F.col("id").isNotNull())
    open_ = known.where((F.col("u") > most) | _left_out(F.col("id"), how)).select("id", "y")
    if many <= how.sent:
        given = given.join(F.broadcast(open_.select("id")), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1), 1 << 19):
                words, counts = _words(data, offsets, how.bits)
                for no, model in enumerate(models):
                    p, lang = model.probabilities(words, counts)
                    bins = np.minimum((p * how.bins).astype(np.int32), how.bins - 1)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(np.full(len(p), no, np.int32)), pa.array(lang.astype(np.int32)), pa.array(bins)], names=["id", "no", "lang", "bin"])

    raw = given.mapInArrow(lean(run), T.StructType([given.schema["id"], *(T.StructField(c, T.IntegerType()) for c in ("no", "lang", "bin"))]))
    counted = raw.join(open_, "id").groupBy("no", "lang", (F.col("y") > 0).cast("int").alias("y"), "bin").agg(F.count(F.lit(1)).alias("n"))
    got = counted.toArrow()  # at most nets x languages x 2 x bins rows
    tried = []
    for no, model in enumerate(models):
        counts = np.zeros((len(model.thresholds), 2, how.bins), np.int64)
        own = got.column("no").to_numpy() == no
        lang, y, at, n = (got.column(c).to_numpy()[own] for c in ("lang", "y", "bin", "n"))
        np.add.at(counts, (lang, y, at), n)
        every, f1 = best_threshold(*counts.sum(0)) if counts[:, 1].any() else (0.5, 0.0)
        model.thresholds[:] = every
        good = []
        for k, (clean, toxic) in enumerate(counts):
            if toxic.sum() >= how.least:
                model.thresholds[k], f = best_threshold(clean, toxic)
                good.append(f)
        tried.append(float(np.mean(good or [f1])))
    return models[int(np.argmax(tried))]


def score(docs: DataFrame, model: Model, *, text: str = "text", out: str = "toxicity", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``out``, the score of the whole text; a null text is scored as an empty one.

    A column named like ``out`` (in any case) is replaced. Repeated rows are scored each; an empty table gives an empty one.
    """
    text_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != out.lower()]
    body = free_name(docs.select(*kept), "body")
    source = docs.select(*kept, docs[text].alias(body))
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(*_words(data, offsets, model.bits)) for _, _, data, offsets in slices(batch.column(len(kept)), 1 << 19)]
            column = pa.array(np.concatenate([np.zeros(0), *parts]), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), column], names=[*kept, out])

    return source.mapInArrow(lean(run), schema)
