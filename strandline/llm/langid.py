"""Language identification by a byte convolutional network.

A text is cut into windows of a fixed number of bytes; all windows of a batch
go through filters of width two to four, max pooling and softmax at once, and a
text takes the language with the highest mean log probability over all its
windows. A filter's response is a sum over pairs of bytes, so after training
the filters become two tables by byte pair, and a window costs two look-ups per
position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import LOWER, row_ids, slices
from .convnet import TextConv, softmax
from .shelf import free_name, lean, text_batches
from .toxicity import draw, remainder

WIDTHS = (2, 3, 4)
UNDETERMINED = "und"
#: Languages whose cut is sent to every task; more of them are joined.
SENT = 100_000


@dataclass(frozen=True)
class Fit:
    """Whole texts are learned from, those whose ids hash lowest: of each language at most ``documents`` with ``windows`` windows
    in all (one text at least). With more languages than ``windows * languages`` windows allow, they share that total."""

    documents: int = 400
    windows: int = 6_000
    languages: int = 100
    width: int = 128
    dim: int = 8
    filters: int = 8
    epochs: int = 6


def cut(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all rows, padded by blanks, and their number by row; an empty row has none."""
    counts = -(-np.diff(offsets) // width)
    first = np.concatenate([[0], np.cumsum(counts)])
    rows = row_ids(counts)
    at = offsets[:-1][rows] + (np.arange(first[-1]) - first[rows]) * width
    out = np.full((len(at), width), 32, np.uint8)
    for a in range(0, len(at), 8192):  # places take eight bytes for each of a window
        place = at[a : a + 8192, None] + np.arange(width)
        inside = place < offsets[1:][rows[a : a + 8192]][:, None]
        out[a : a + 8192][inside] = LOWER[data[place[inside]]]
    return out, counts


class Model:
    """Languages and the tables of a trained net."""

    def __init__(self, languages: list[str], net: TextConv | None, width: int):
        self.languages, self.width = languages, width
        if net is None:
            return
        e = net.tables[0][:256]
        taps = {(w, j): e @ k[j] for w, k in zip(net.widths, net.kernels) for j in range(w)}
        pair = lambda x, y: (x[:, None, :] + y[None, :, :]).reshape(65536, -1)
        none = np.zeros((256, net.filters), np.float32)
        self.near = np.concatenate([pair(taps[w, 0], taps[w, 1]) for w in WIDTHS], 1).astype(np.float32)
        self.far = np.concatenate([pair(taps[3, 2], none), pair(taps[4, 2], taps[4, 3])], 1).astype(np.float32)
        self.skip = net.filters
        self.bias, self.head, self.offset = net.bias, net.heads[0], net.offsets[0]

    def window_logs(self, windows: np.ndarray) -> np.ndarray:
        """Log probability of each language for each window."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for a in range(0, len(windows), 256):
            w = windows[a : a + 256].astype(np.int32)
            pairs = w[:, :-1] << 8 | w[:, 1:]
            r = self.near[pairs[:, :-2]]
            r[:, :, self.skip :] += self.far[pairs[:, 2:]]
            f = np.maximum(r.max(1) + self.bias, 0)
            out[a : a + 256] = np.log(softmax(f @ self.head + self.offset) + 1e-9)
        return out

    def predict(self, windows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language and its score for each row that has windows; -1 and 0 for others."""
        best, score = np.full(len(counts), -1), np.zeros(len(counts))
        full = counts > 0
        if len(self.languages) and full.any():
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[full]
            p = softmax(np.add.reduceat(self.window_logs(windows).astype(float), starts, axis=0) / counts[full, None])
            best[full], score[full] = p.argmax(1), p.max(1)
        return best, score


def fit(docs: DataFrame, *, text: str = "text", key: str = "doc_id", lang: str = "lang", how: Fit = Fit()) -> Model:
    """Learn all languages from rows with a language whose id has not the remainder 1.

    Rows with a null id, text or language or an empty text teach nothing; of rows that repeat id, language and text one counts.
    An empty table gives a model without languages.
    """
    text_batches(docs.sparkSession)
    given = docs.select(docs[key].alias("id"), docs[lang].cast("string").alias("lang"), docs[text].alias("body")).where(F.col("lang").isNotNull() & F.col("id").isNotNull() & (F.col("body") != "") & (remainder(F.col("id"), 3) != 1))
    names = given.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    seen = names.agg(F.count(F.lit(1))).first()[0]
    own = max(1, min(how.windows, how.windows * how.languages // max(1, seen)))  # windows of a language
    # Only about four times the sample is ranked, however many rows and tasks a language has.
    cut_off = names.select("lang", (F.lit(4.0 * how.documents) / F.col("n")).alias("most"))
    cut_off = F.broadcast(cut_off) if seen <= SENT else cut_off
    low = given.withColumn("u", draw(F.col("id"))).join(cut_off, "lang").where(F.col("u") < F.col("most"))
    low = low.select("id", "lang", "u", F.xxhash64("body").alias("h"), F.ceil(F.octet_length("body") / how.width).alias("n_windows")).distinct()
    by_draw = Window.partitionBy("lang").orderBy("u", "id", "h")
    ranked = low.withColumn("place", F.row_number().over(by_draw)).withColumn("total", F.sum("n_windows").over(by_draw.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = ranked.where((F.col("place") == 1) | ((F.col("place") <= how.documents) & (F.col("total") <= own))).select("id", "lang", "h")
    # Sent to all tasks: at most one row for each ``width`` bytes of the windows' total, or for each language.
    found = given.withColumn("h", F.xxhash64("body")).join(F.broadcast(chosen), ["id", "lang", "h"]).dropDuplicates(["id", "lang", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(2)):
                windows, counts = cut(data, offsets, how.width)
                take = pa.array(row_ids(counts))
                ids = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays([ids.column(0).take(take), ids.column(1).take(take), pa.array([w.tobytes() for w in windows], pa.binary())], names=["h", "lang", "window"])

    got = found.select("h", "lang", "body").mapInArrow(lean(run), "h long, lang string, window binary").toArrow()  # at most windows * languages rows, or a text of each language
    rows = sorted(zip(got.column("lang").to_pylist(), got.column("window").to_pylist()))
    languages = sorted({x for x, _ in rows})
    if len(languages) < 2:
        return Model(languages, None, how.width) if not languages else Constant(languages, how.width)
    number = {x: i for i, x in enumerate(languages)}
    sample = [(np.frombuffer(w, np.uint8)[:, None], [number[x]]) for x, w in rows]
    mixed = [sample[i] for i in np.random.default_rng(1).permutation(len(sample))]
    net = TextConv([256], how.dim, WIDTHS, how.filters, [len(languages)])
    net.train(mixed, epochs=min(40, max(how.epochs, round(400 * 64 / len(mixed)))))
    return Model(languages, net, how.width)


class Constant(Model):
    """One learned language: every text is in it."""

    def __init__(self, languages: list[str], width: int):
        super().__init__(languages, None, width)

    def window_logs(self, windows: np.ndarray) -> np.ndarray:
        return np.zeros((len(windows), 1), np.float32)


def predict(docs: DataFrame, model: Model, *, text: str = "text", out: str = "lang_pred", score: str = "lang_score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the language of the whole text and its score.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if no language was learned. Columns
    named like the new ones (in any case) are replaced. Repeated rows are predicted each; an empty table gives an empty one.
    """
    text_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (out.lower(), score.lower())]
    body, flag = free_name(docs, "body"), free_name(docs, "has_letter")
    source = docs.select(*kept, docs[text].alias(body), F.coalesce(docs[text].rlike(r"\p{L}"), F.lit(False)).alias(flag))
    schema = T.StructType([*(source.schema[c] for c in kept), T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in batches:
            letters = batch.column(len(kept) + 1).to_numpy(zero_copy_only=False)
            best, sure = [np.zeros(0, np.int64)], [np.zeros(0)]
            for _, _, data, offsets in slices(batch.column(len(kept))):
                b, s = model.predict(*cut(data, offsets, model.width))
                best.append(b)
                sure.append(s)
            b, s = np.concatenate(best), np.concatenate(sure)
            b, s = np.where(letters, b, -1), np.where(letters & (b >= 0), s, 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(names[b], pa.string()), pa.array(s, pa.float64())], names=[*kept, out, score])

    return source.mapInArrow(lean(run), schema)
