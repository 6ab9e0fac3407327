"""Language-model scoring by Brown's class-based bigrams.

Every word has a class, and log P(text) sums log P(class | class before) and
log P(word | class). Exchange clustering moves units between classes while that
raises the likelihood of the training bigrams. It has two steps. The core, the most
frequent words and groups of words with equal endings, is exchanged one unit at a
time until nothing moves: its counts are one square matrix of fixed size, summed
over all training texts. Then every other word that occurs often enough is
exchanged too, in rounds: how often it stands before and after each class is
counted over all texts and packed by word, and each part of the vocabulary moves
its words to their best classes, until the likelihood hardly rises. So the clustered
vocabulary grows with the corpus; rarer words, seen or not, share the class of their
ending. Class transitions are smoothed by Witten and Bell's rule, emissions by adding
one, with one unseen word for each ending.

The counts of all words stay in a table. The most frequent ones, a bounded
number, travel to the executors; counts of the others are joined to the texts
that use them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import Lookup, hashes, lower_words, row_ids, slices
from .shelf import Shelf, lean, text_batches
from .toxicity import remainder

#: Hash that stands for the end of a text.
END = np.uint64(0x5EED0FE2D)


#: Tokens whose contexts a task counts at a time, words of a part of the vocabulary, and packed rows that are summed at a time.
FLUSH, PART, FAN = 1 << 22, 1 << 13, 48
_PACKED = "part int, words binary, sizes binary, slots binary, counts binary"


@dataclass(frozen=True)
class Classes:
    """``classes`` of words. The ``own`` most frequent ones and ``endings`` groups by the last ``tail`` bytes are the core; other
    words that occur at least ``least`` times are exchanged after it, until a round raises the log likelihood by less than the share
    ``rise``. ``sent`` words travel, the most frequent ones; only these can have a class of their own."""

    classes: int = 96
    own: int = 768
    endings: int = 256
    tail: int = 3
    least: int = 64
    rise: float = 0.002
    sent: int = 1 << 19

    @property
    def core(self) -> int:
        return 1 + self.own + self.endings


def tokens(data: np.ndarray, offsets: np.ndarray, how: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending (0 for the end) of all tokens of all rows, each row followed by the end, and the tokens by row."""
    data, starts, ends, counts, h = lower_words(data, offsets)
    e = (hashes(data, np.maximum(starts, ends - how.tail), ends) % np.uint64(how.endings)).astype(np.int32) + 1 if len(h) else np.zeros(0, np.int32)
    rows = row_ids(counts)
    place = np.arange(len(h)) + rows
    total = len(h) + len(counts)
    hash_, ending = np.full(total, END, np.uint64), np.zeros(total, np.int32)
    hash_[place], ending[place] = h, e
    return hash_, ending, counts + 1


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.where(x > 0, x, 1)), 0)


def exchange(bigrams: np.ndarray, classes: int) -> np.ndarray:
    """The class of each unit. Unit 0, the end of a text, is class 0 alone; the others move to the class that gives the
    training bigrams the highest likelihood, in order of frequency, until a round moves none."""
    n = len(bigrams)
    bigrams = bigrams.astype(float)
    out, into, selfs = bigrams.sum(1), bigrams.sum(0), np.diag(bigrams).copy()
    order = np.lexsort((np.arange(1, n), -(out + into)[1:])) + 1
    at = np.zeros(n, np.int64)
    k = max(1, min(classes, n) - 1)
    at[order] = 1 + np.minimum(np.arange(n - 1), k - 1) if n - 1 <= k else 1 + np.arange(n - 1) % k
    k += 1
    member = np.zeros((n, k))
    member[np.arange(n), at] = 1
    right, left = bigrams @ member, (member.T @ bigrams).T  # of a unit: to and from each class
    pairs, rows, cols = member.T @ right, member.T @ out, member.T @ into
    movable = [u for u in order if out[u] + into[u] > 0]
    moved = 1
    while moved:  # each move raises the likelihood, so this ends
        moved = 0
        for u in movable:
            a = at[u]
            r, l, s = right[u].copy(), left[u].copy(), selfs[u]
            r[a] -= s
            l[a] -= s
            pairs[a] -= r
            pairs[:, a] -= l
            pairs[a, a] -= s
            rows[a] -= out[u]
            cols[a] -= into[u]
            gain = (_x_log_x(pairs + r) - _x_log_x(pairs)).sum(1) + (_x_log_x(pairs + l[:, None]) - _x_log_x(pairs)).sum(0)
            d = np.diag(pairs)
            gain += _x_log_x(d + r + l + s) - _x_log_x(d + r) - _x_log_x(d + l) + _x_log_x(d)
            gain -= _x_log_x(rows + out[u]) - _x_log_x(rows) + _x_log_x(cols + into[u]) - _x_log_x(cols)
            gain[0] = -np.inf
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            pairs[b] += r
            pairs[:, b] += l
            pairs[b, b] += s
            rows[b] += out[u]
            cols[b] += into[u]
            if b != a:
                moved += 1
                at[u] = b
                right[:, a] -= bigrams[:, u]
                right[:, b] += bigrams[:, u]
                left[:, a] -= bigrams[u]
                left[:, b] += bigrams[u]
    return at


def likelihood(pairs: np.ndarray) -> float:
    """The part of the bigrams' log likelihood that depends on the classes."""
    return float(_x_log_x(pairs).sum() - _x_log_x(pairs.sum(1)).sum() - _x_log_x(pairs.sum(0)).sum())


def best_classes(after: np.ndarray, before: np.ndarray, selfs: np.ndarray, at: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The class that gives the bigrams the highest likelihood for each word, were it the only one to move.

    ``after`` and ``before`` count how often each class follows and precedes each word (rows), ``selfs`` how often it follows itself;
    ``at`` are the present classes, ``pairs`` the counts of class pairs. Class 0, the end of a text, takes no word.
    """
    out, k = at.copy(), len(pairs)
    logs, rows, cols = _x_log_x(pairs), pairs.sum(1), pairs.sum(0)
    for i, a in enumerate(at):
        r, l, s = after[i].astype(float), before[i].astype(float), float(selfs[i])
        n_out, n_in = r.sum(), l.sum()
        if not n_out + n_in:
            continue
        r[a] -= s
        l[a] -= s
        p, x, row, col = pairs.copy(), logs.copy(), rows.copy(), cols.copy()
        p[a] -= r
        p[:, a] -= l
        p[a, a] -= s
        x[a], x[:, a] = _x_log_x(p[a]), _x_log_x(p[:, a])
        row[a] -= n_out
        col[a] -= n_in
        right, left = np.flatnonzero(r), np.flatnonzero(l)
        gain = (_x_log_x(p[:, right] + r[right]) - x[:, right]).sum(1) + (_x_log_x(p[left] + l[left, None]) - x[left]).sum(0)
        d = np.diag(p)
        gain += _x_log_x(d + r + l + s) - _x_log_x(d + r) - _x_log_x(d + l) + np.diag(x)
        gain -= _x_log_x(row + n_out) - _x_log_x(row) + _x_log_x(col + n_in) - _x_log_x(col)
        gain[0] = -np.inf
        b = int(gain.argmax())
        if k > 1 and gain[b] > gain[a] + 1e-9:
            out[i] = b
    return out


class Model:
    """Counts of the frequent words, classes of all units, and log10 probabilities of the classes."""

    def __init__(self, how: Classes, keys: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        """``keys, counts``: the words that travel, most frequent first, with the end in front."""
        self.how, self.keys, self.counts, self.total, self.distinct = how, keys, counts, total, distinct
        self.log_counts = np.log10(np.concatenate([counts, [0]]) + 1.0)  # the last is that of place -1
        #: Single words: the core's, and those that occur often enough.
        self.own = min(max(how.own, int((counts[1:] >= how.least).sum())), max(how.own, len(keys) - 1))
        self.lookup: Lookup | None = None

    def place(self, h: np.ndarray) -> np.ndarray:
        if self.lookup is None:
            self.lookup = Lookup(self.keys)
        return self.lookup.find(h)

    def __getstate__(self):
        return self.__dict__ | {"lookup": None}

    def units(self, place: np.ndarray, ending: np.ndarray, own: int | None = None) -> np.ndarray:
        """0: the end; then ``own`` single words by rank; then endings."""
        own = self.own if own is None else own
        return np.where((place >= 0) & (place <= own), place, own + ending)

    def start(self, core: np.ndarray, ending: np.ndarray) -> None:
        """Classes of all units from those of the core; ``ending``: of the single words, by place."""
        how = self.how
        self.classes = np.concatenate([core[: 1 + how.own], core[how.own + ending[1 + how.own : 1 + self.own]], core[1 + how.own :]]).astype(np.int32)

    def finish(self, pairs: np.ndarray, unit_tokens: np.ndarray, unit_words: np.ndarray) -> None:
        """``pairs``: counts of class pairs; ``unit_tokens``, ``unit_words``: training tokens and distinct words of each unit."""
        k = len(pairs)
        sums = lambda x: np.bincount(self.classes, x, k)
        before, follow = pairs.sum(1), (pairs > 0).sum(1)
        every = (sums(unit_tokens) + 1) / (self.total + k)
        weight = np.maximum(before + follow, 1)
        smoothed = np.where(before[:, None] > 0, (pairs + follow[:, None] * every) / weight[:, None], every)
        self.log_steps = np.log10(smoothed)
        unseen = np.zeros(len(self.classes))
        unseen[1 + self.own :] = 1
        self.log_room = np.log10(np.maximum(sums(unit_tokens + unit_words + unseen), 1))


def _emit(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def word_counts(texts: DataFrame, how: Classes) -> DataFrame:
    """``h, ending, c`` of all distinct tokens of the column ``body``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0), 4 << 20):
                h, ending, _ = tokens(data, offsets, how)
                h, first, c = np.unique(h, return_index=True, return_counts=True)
                yield _emit(["h", "ending", "c"], h.view(np.int64), ending[first], c.astype(np.int64))

    return texts.mapInArrow(lean(run), "h long, ending int, c long").groupBy("h", "ending").agg(F.sum("c").alias("c"))


def _steps(batches: Iterator[pa.RecordBatch], how: Classes, unit) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Unit before and unit of each token; the end stands before a text's first word."""
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0), 4 << 20):
            h, ending, _ = tokens(data, offsets, how)
            u = unit(h, ending).astype(np.int64)
            # every text ends by unit 0, so the token before a first word is a 0 too
            yield np.concatenate([[0], u[:-1]]), u


def core_bigrams(texts: DataFrame, model: Model) -> np.ndarray:
    """Counts of pairs of core units over all texts."""
    units, how = model.how.core, model.how

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(units * units, np.int64)
        for before, u in _steps(batches, how, lambda h, ending: model.units(model.place(h), ending, how.own)):
            seen += np.bincount(before * units + u, minlength=units * units)
        full = np.flatnonzero(seen)
        yield _emit(["pair", "n"], full, seen[full])

    got = texts.mapInArrow(lean(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most core ** 2 rows
    out = np.zeros(units * units)
    out[got.column("pair").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(units, units)


def contexts(texts: DataFrame, model: Model) -> DataFrame:
    """``part, words, sizes, slots, counts``: packed class contexts of the single words outside the core; part -1 has class pairs.

    A slot is a class that follows, a class that precedes (from ``k`` on), or the word itself (``2 * k``).
    """
    how, own, k = model.how, model.own, int(model.classes.max()) + 1
    width = 2 * k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, held, many = np.zeros(k * k, np.int64), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            held.clear()
            cuts = np.searchsorted(keys // width // PART, np.arange(int(keys[-1] // width // PART) + 2 if len(keys) else 1))
            for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if b > a:
                    yield _pack(part, keys[a:b], n[a:b], width)

        for before, u in _steps(batches, how, lambda h, ending: model.units(model.place(h), ending)):
            c, d = model.classes[before].astype(np.int64), model.classes[u].astype(np.int64)
            pairs += np.bincount(c * k + d, minlength=k * k)
            for units, slot in ((before, d), (u, c + k)):
                mine = (units > how.own) & (units <= own)
                held.append((units[mine] - 1 - how.own) * width + slot[mine])
            twice = u[(before == u) & (u > how.own) & (u <= own)]
            held.append((twice - 1 - how.own) * width + 2 * k)
            many += len(u)
            if many >= FLUSH:
                yield from out()
                many = 0
        yield from out()
        yield _emit(["part", "words", "sizes", "slots", "counts"], pa.array([-1], pa.int32()), *(pa.array([x], pa.binary()) for x in (b"", b"", b"", pairs.tobytes())))

    return texts.mapInArrow(lean(run), _PACKED)


def _pack(part: int, keys: np.ndarray, n: np.ndarray, width: int) -> pa.RecordBatch:
    """One row with the counts ``n`` of ``keys`` = word * width + slot, in order."""
    words, sizes = np.unique(keys // width, return_counts=True)
    small = np.uint32 if not len(n) or n.max() < 1 << 32 else np.uint64
    blobs = [x.tobytes() for x in (words.astype(np.int32), sizes.astype(np.uint32), (keys % width).astype(np.uint16), n.astype(small))]
    return _emit(["part", "words", "sizes", "slots", "counts"], pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs))


def _dense(table: pa.Table, width: int, size: int) -> np.ndarray:
    """The sum of the packed rows of a part of ``size`` words: words by slots."""
    out = np.zeros((size, width), np.int64)
    low = table.column("part")[0].as_py() * size
    for words, sizes, slots, counts in zip(*(table.column(c).to_pylist() for c in ("words", "sizes", "slots", "counts"))):
        slot = np.frombuffer(slots, np.uint16)
        n = np.frombuffer(counts, np.uint32 if len(counts) == 4 * len(slot) else np.uint64)
        out[np.repeat(np.frombuffer(words, np.int32) - low, np.frombuffer(sizes, np.uint32)), slot] += n.astype(np.int64)  # a word and a slot stand once in a row
    return out


def summed(packed: DataFrame, k: int, shelf: Shelf) -> DataFrame:
    """The packed rows, summed until a part has at most ``FAN``: no task takes more at a time, however many there are."""
    width = 2 * k + 1

    def one(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        if part < 0:
            whole = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
            return pa.table({"part": pa.array([part], pa.int32()), **{c: pa.array([b""], pa.binary()) for c in ("words", "sizes", "slots")}, "counts": pa.array([whole.tobytes()], pa.binary())})
        dense = _dense(table, width, PART).ravel()
        full = np.flatnonzero(dense)
        return pa.Table.from_batches([_pack(part, full + part * PART * width, dense[full], width)])

    while True:
        most = packed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= FAN:
            return packed
        salted = packed.withColumn("salt", F.pmod(F.xxhash64("slots", "counts"), F.lit(-(-most // FAN))))
        fewer = shelf.put(salted.groupBy("part", "salt").applyInArrow(one, _PACKED))
        shelf.drop(packed)
        packed = fewer


def moved(packed: DataFrame, model: Model, pairs: np.ndarray) -> np.ndarray:
    """The classes of all units after each single word outside the core has moved to its best class."""
    k, first, classes = len(pairs), 1 + model.how.own, model.classes

    def move(table: pa.Table) -> pa.Table:
        low, dense = table.column("part")[0].as_py() * PART, _dense(table, 2 * k + 1, PART)
        at = classes[first + low : min(first + low + PART, first + model.own - model.how.own)]
        new = best_classes(dense[: len(at), :k], dense[: len(at), k : 2 * k], dense[: len(at), 2 * k], at, pairs)
        other = np.flatnonzero(new != at)
        return pa.table({"unit": pa.array(first + low + other, pa.int64()), "to": pa.array(new[other], pa.int32())})

    got = packed.where("part >= 0").groupBy("part").applyInArrow(move, "unit long, to int").toArrow()  # at most ``sent`` rows
    out = classes.copy()
    out[got.column("unit").to_numpy()] = got.column("to").to_numpy()
    return out


def exchange_rest(texts: DataFrame, model: Model, shelf: Shelf) -> np.ndarray:
    """Exchange the single words outside the core in rounds; the counts of class pairs."""
    k, last = int(model.classes.max()) + 1, None
    while True:
        packed = summed(shelf.put(contexts(texts, model)), k, shelf)
        pairs = np.zeros(k * k)
        for r in packed.where("part = -1").select("counts").collect():  # at most ``FAN`` rows
            pairs += np.frombuffer(r.counts, np.int64)
        pairs = pairs.reshape(k, k)
        now = likelihood(pairs)
        if last is not None and now - last[0] < model.how.rise * abs(last[0]):
            if now < last[0]:
                _, model.classes, pairs = last
            shelf.drop(packed)
            return pairs
        new = moved(packed, model, pairs)
        shelf.drop(packed)
        if (new == model.classes).all():
            return pairs
        last, model.classes = (now, model.classes, pairs), new


def fit(texts: DataFrame, shelf: Shelf, how: Classes = Classes()) -> tuple[Model, DataFrame]:
    """The model of the column ``body`` of all rows, and the table of all word counts."""
    counts = shelf.put(word_counts(texts, how))
    whole = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    level = F.floor(F.log2("c") * 32)
    by_level = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    least, fit_in = None, how.sent
    for r in by_level:
        if r.n > fit_in:
            break
        least, fit_in = r.level, fit_in - r.n
    got = counts.where(level >= (least if least is not None else 1 << 20)).select("h", "ending", "c").toArrow()
    h, ending, c = got.column("h").to_numpy().view(np.uint64), got.column("ending").to_numpy(), got.column("c").to_numpy()
    words = np.flatnonzero(h != END)
    order = words[np.lexsort((h[words], -c[words]))]
    ends = int(counts.where(F.col("h") == int(END)).agg(F.sum("c")).first()[0] or 0)
    model = Model(how, np.concatenate([np.array([END], np.uint64), h[order]]), np.concatenate([[ends], c[order]]).astype(np.int64), int(whole.n or 0), int(whole.v))
    if not model.total:
        return model, counts
    bigrams = core_bigrams(texts, model)
    core = exchange(bigrams, how.classes)
    ending = np.concatenate([[0], ending[order]])
    model.start(core, ending)
    if model.own > how.own:
        pairs = exchange_rest(texts, model, shelf)
    else:
        member = np.zeros((how.core, int(core.max()) + 1))
        member[np.arange(how.core), core] = 1
        pairs = member.T @ bigrams @ member
    unit_tokens, unit_words = np.zeros(len(model.classes)), np.zeros(len(model.classes))
    for r in counts.groupBy("ending").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        unit = model.own + r.ending if r.ending else 0
        unit_tokens[unit], unit_words[unit] = r.n, r.v
    single = slice(1, 1 + min(model.own, len(model.keys) - 1))
    unit_tokens[single], unit_words[single] = model.counts[single], 1
    np.subtract.at(unit_tokens, model.own + ending[single], model.counts[single])
    np.subtract.at(unit_words, model.own + ending[single], 1)
    model.finish(pairs, unit_tokens, unit_words)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame, shelf: Shelf, *, text: str, keep: list[str]) -> DataFrame:
    """``keep`` with ``n_tokens, n_known, train_tokens, base_score, score`` of each row; a null text is empty."""
    source = docs.select(*(docs[c].alias(f"k_{c}") for c in keep), docs[text].alias("body"))
    kept = source.columns[:-1]
    made = [("n_tokens", T.LongType()), ("n_known", T.LongType()), ("sum_counts", T.DoubleType()), ("sum_classes", T.DoubleType()), ("rare", T.ArrayType(T.LongType())), ("rare_n", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*(source.schema[c] for c in kept), *(T.StructField(*x) for x in made)])
    trained = model.total > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(len(kept))):
                h, ending, n = tokens(data, offsets, model.how)
                starts, rows = np.concatenate([[0], np.cumsum(n)[:-1]]), row_ids(n)
                place = model.place(h)
                sums = np.add.reduceat(model.log_counts[place], starts)
                known = np.add.reduceat((place >= 0) & trained, starts, dtype=np.int64)
                classes = np.zeros(len(n))
                if trained:
                    c = model.classes[model.units(place, ending)]
                    classes = np.add.reduceat(model.log_steps[np.concatenate([[0], c[:-1]]), c] - model.log_room[c], starts)
                rare = np.flatnonzero(place < 0) if trained else np.zeros(0, np.int64)
                order = rare[np.lexsort((h[rare], rows[rare]))]
                rh, rr = h[order], rows[order]
                new = np.ones(len(order), bool)
                new[1:] = (rh[1:] != rh[:-1]) | (rr[1:] != rr[:-1])
                at = np.flatnonzero(new)
                lists = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rr[at], minlength=len(n)))]), pa.int32())
                rest = batch.slice(first, end - first)
                yield _emit(
                    [*kept, *(x for x, _ in made)], *(rest.column(i) for i in range(len(kept))), n.astype(np.int64), known, sums, classes,
                    pa.ListArray.from_arrays(lists, pa.array(rh[at].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(np.diff(np.append(at, len(order))).astype(np.int32))),
                )

    # The row numbers are stored with the rows, so they stay the same in every later read.
    found = shelf.put(source.mapInArrow(lean(run), schema).withColumn("row", F.monotonically_increasing_id()))
    each = found.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.rare_n").alias("n"))
    seen = each.join(counts.select("h", "c"), "h").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_counts"), F.sum("n").alias("rare_known"))
    out = found.select(*kept, "row", "n_tokens", "n_known", "sum_counts", "sum_classes").join(seen, "row", "left")
    every = F.col("sum_counts") + F.coalesce("rare_counts", F.lit(0.0))
    base = every - F.col("n_tokens") * F.lit(float(np.log10(model.total + model.distinct + 1)))
    return out.select(
        *(F.col(k).alias(c) for k, c in zip(kept, keep)),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (every + F.col("sum_classes")).alias("score"),
    )


def score_held_out(docs: DataFrame, *, text: str = "text", key: str = "doc_id", by: int = 7, out: int = 2, how: Classes = Classes()) -> DataFrame:
    """``key, held_out`` and the scores of all rows, learned from the rows whose id has not the remainder ``out``.

    A null text is an empty one: one token, the end. A null id counts as empty text in the remainder. Repeated rows are
    counted and scored each, very long texts in parts. Without a training row all scores are 0. An empty table gives an
    empty one. Other columns aren't read.
    """
    text_batches(docs.sparkSession)
    shelf = Shelf(docs.sparkSession, "brown")
    held: Column = remainder(F.col(key), by) == out
    model, counts = fit(docs.where(~held).select(docs[text].alias("body")), shelf, how)
    scored = score(docs, model, counts, shelf, text=text, keep=[key])
    return scored.select(key, held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
