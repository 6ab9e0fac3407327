"""Near-duplicates by MinHash with tensored banding.

A document's set holds the hashes of its distinct five-word shingles. Equal sets
form a class, and only one member of a class goes on. Two collections A and B of
``side`` sketches of two minhashes each are taken; a table key combines one sketch
of A with one of B, so ``side ** 2`` tables of four minhashes cost
``4 * side`` minhashes instead of ``4 * side ** 2``. At a similarity of 0.75 a pair
shares no table with probability 2 * (1 - 0.75 ** 2) ** side, 2e-5 for 14.

Sketches that only one class has can't make a shared key, so they are left out
before keys are made. In a bucket each member is first held against the one whose
sketches most others share, mostly a text that the rest are copied from. That joins
most copies, and pairs inside a component need no look any more. All other pairs of
a bucket are compared on full sets: in a bucket of few members one by one; the members
of large buckets make families, whose sets are dealt into blocks of bounded size,
and every block is held against every other. No pair that shares a table is left out,
so one such step is enough. Sets are made once, for the classes that share a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import lower_words, mix, row_ids, slices
from .components import components, joined
from .shelf import Shelf, free_name, lean, text_batches

#: Parts of a family that meet its sums apart.
SALTS = 64
GOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Banding:
    """``words`` a shingle; ``percent`` similarity; ``side`` sketches in each collection. Buckets of at most ``small`` members are
    compared pair by pair, larger ones in blocks of about ``block`` shingles, where a set counts as ``least`` at least; a
    family of some size has ``deal`` blocks or more."""

    words: int = 5
    percent: int = 75
    side: int = 14
    small: int = 64
    block: int = 1 << 19
    least: int = 256
    deal: int = 8

    @property
    def hashes(self) -> int:
        return 4 * self.side


def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one after the other, and their number by row.

    A row of fewer words than ``words`` has its whole sequence as one shingle, a row without words none.
    """
    _, _, _, counts, h = lower_words(data, offsets)
    odd, end_marks = _multipliers(words, 77), np.arange(1, words + 1, dtype=np.uint64) * GOLD
    n_rows = len(counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    made = np.maximum(counts - words + 1, 0)
    whole = (counts > 0) & (made == 0)
    rows = row_ids(np.where(whole, 1, made))
    total = int(made.sum() + whole.sum())
    if not total:
        return np.zeros(0, np.uint64), np.zeros(n_rows, np.int64)
    ends = np.concatenate([[0], np.cumsum(np.where(whole, 1, made))])
    at = first[rows] + np.arange(total) - ends[rows]
    left = first[rows + 1]
    out = np.zeros(total, np.uint64)
    padded = np.concatenate([h, np.zeros(words, np.uint64)])
    for k in range(words):
        out += np.where(at + k < left, padded[at + k] * odd[k], end_marks[k])
    out = mix(out)
    order = np.lexsort((out, rows))
    out, rows = out[order], rows[order]
    new = np.ones(total, bool)
    new[1:] = (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])
    return out[new], np.bincount(rows[new], minlength=n_rows)


def digests(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart, as two signed numbers of each set; zeros for an empty one."""
    both = []
    full = sizes > 0
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[full] if len(sizes) else np.zeros(0, np.int64)
    for odd in (GOLD, np.uint64(0xD6E8FEB86659FD93)):
        out = np.zeros(len(sizes), np.uint64)
        if full.any():
            out[full] = mix(np.add.reduceat(mix(sets ^ odd), starts) + sizes[full].astype(np.uint64) * odd)
        both.append(out.view(np.int64))
    return both[0], both[1]


def minhashes(sets: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """``n`` minhashes of 32 bits for each row; zeros for an empty set."""
    out = np.zeros((len(sizes), n), np.uint32)
    full = sizes > 0
    if full.any():
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[full]
        for k, a in enumerate(_multipliers(n, 4242)):
            out[full, k] = np.minimum.reduceat(((sets * a) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    got = column.to_pylist()
    return np.frombuffer(b"".join(got), dtype).reshape(len(got), -1)


def profiles(docs: DataFrame, *, text: str, key: str, how: Banding) -> DataFrame:
    """``id, n, d1, d2, sig`` of each row: set size, digest of the set, minhashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _column(batch, "id")
            for first, end, data, offsets in slices(_column(batch, "body")):
                sets, sizes = shingle_sets(data, offsets, how.words)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, end - first), pa.array(sizes.astype(np.int64)), *map(pa.array, digests(sets, sizes)), _binary(minhashes(sets, sizes, how.hashes))],
                    names=["id", "n", "d1", "d2", "sig"],
                )

    return docs.select(docs[key].cast("long").alias("id"), docs[text].alias("body")).mapInArrow(lean(run), "id long, n long, d1 long, d2 long, sig binary")


def set_classes(rows: DataFrame) -> DataFrame:
    """``node, d1, d2, id, n, sig`` of each distinct set; to be written before use, since ``node`` is numbered anew in each run."""
    each = rows.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    return each.withColumn("node", F.monotonically_increasing_id())


def _sketches(sig: np.ndarray) -> np.ndarray:
    """Pairs of minhashes as one number, with the place of the sketch mixed in."""
    two = sig.astype(np.uint64)
    return mix((two[:, 0::2] << np.uint64(32) | two[:, 1::2]) + np.arange(1, sig.shape[1] // 2 + 1, dtype=np.uint64) * GOLD)


def table_keys(classes: DataFrame, how: Banding) -> DataFrame:
    """``key, node, n, pop``: the tensored keys that another class may have too, and how many classes share the node's sketches."""
    side = how.side

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = _column(batch, "node").to_numpy()
            s = _sketches(_matrix(_column(batch, "sig"), np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array(s.reshape(-1).view(np.int64)), pa.array(np.repeat(node, 2 * side)), pa.array(np.tile(np.arange(2 * side, dtype=np.int32), len(node)))], names=["part", "node", "no"])

    single = classes.select("node", "sig").mapInArrow(lean(parts), "part long, node long, no int")
    shared = single.groupBy("part").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    shared = single.join(shared, "part").groupBy("node").agg(F.expr("bit_or(shiftleft(1L, no))").alias("mask"), F.sum("many").alias("pop"))
    a_side = (1 << side) - 1
    shared = shared.where((F.col("mask").bitwiseAND(F.lit(a_side)) != 0) & (F.col("mask").bitwiseAND(F.lit(a_side << side)) != 0))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                node, sizes, mask, pop = (_column(part, c).to_numpy() for c in ("node", "n", "mask", "pop"))
                s = _sketches(_matrix(_column(part, "sig"), np.uint32))
                has = (mask[:, None] >> np.arange(2 * side)) & 1 > 0
                both = has[:, :side, None] & has[:, None, side:]
                keys = mix(s[:, :side, None] * GOLD + s[:, None, side:])
                made = both.sum((1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(keys[both].view(np.int64)), *(pa.array(np.repeat(x, made)) for x in (node, sizes, pop))], names=["key", "node", "n", "pop"])

    return classes.join(shared, "node").select("node", "n", "sig", "mask", "pop").mapInArrow(lean(pairs), "key long, node long, n long, pop long")


def _sizes_allow(n: Column, m: Column, how: Banding) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(n, m) >= how.percent * F.greatest(n, m)


def hub_pairs(keys: DataFrame, how: Banding) -> DataFrame:
    """Distinct ``a, b``: each member ``b`` of a bucket with its member ``a`` of the highest ``pop``."""
    hub = keys.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.max(F.struct("pop", "node", "n")).alias("hub")).where("members > 1")
    pairs = keys.join(hub, "key").where((F.col("node") != F.col("hub.node")) & _sizes_allow(F.col("n"), F.col("hub.n"), how))
    return pairs.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()


def _with_label(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``nodes`` with ``label``; a node without one is its own."""
    return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def mixed_buckets(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, node, n, label, members`` of the buckets whose members have more than one label."""
    own = _with_label(keys.select("key", "node", "n"), labels)
    by = own.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("label").alias("low"), F.max("label").alias("high"))
    return own.join(by.where("low < high").select("key", "members"), "key").select("key", "node", "n", "label", "members")


def families(mixed: DataFrame, shelf: Shelf, how: Banding) -> DataFrame:
    """``node, family`` of the members of large mixed buckets; buckets with a member in common are of one family."""
    large = mixed.where(F.col("members") > how.small)
    least = large.groupBy("key").agg(F.min("node").alias("a"))
    links = large.join(least, "key").select("a", F.col("node").alias("b")).distinct()
    return components(links, shelf).withColumnRenamed("label", "family")


def small_pairs(mixed: DataFrame, family: DataFrame, how: Banding) -> DataFrame:
    """Distinct ``a, b`` (a < b) of different labels in the small mixed buckets, without those of one family."""
    small = mixed.where(F.col("members") <= how.small).join(family, "node", "left")
    each = small.groupBy("key").agg(F.collect_list(F.struct("node", "label", "n", "family")).alias("every"))
    x = F.col("x")

    def other(y: Column) -> Column:
        apart = ~F.coalesce(y["family"] == x["family"], F.lit(False))
        return (y["node"] > x["node"]) & (y["label"] != x["label"]) & apart & _sizes_allow(x["n"], y["n"], how)

    both = each.select("every", F.explode("every").alias("x")).select("x", F.explode(F.filter("every", other)).alias("y"))
    return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``left`` has in common with each of ``right``.

    Elements that many sets have are counted by a matrix product, the others by their lists of sets.
    """
    out = np.zeros((len(left), len(right)), np.int64)
    sizes = np.array([len(x) for x in (*left, *right)])
    if not sizes.sum():
        return out
    _, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    cut, n = int(sizes[: len(left)].sum()), int(at.max()) + 1
    at_l, at_r = at[:cut], at[cut:]
    rows_l, rows_r = row_ids(sizes[: len(left)]), row_ids(sizes[len(left) :])
    times = np.bincount(at_l, minlength=n) * np.bincount(at_r, minlength=n)
    often = np.flatnonzero(times * 100 > len(left) * len(right))
    for a in range(0, len(often), 1024):
        column = np.full(n, -1)
        column[often[a : a + 1024]] = np.arange(len(often[a : a + 1024]))
        dense = []
        for rows, own, many in ((rows_l, column[at_l], len(left)), (rows_r, column[at_r], len(right))):
            x = np.zeros((many, len(often[a : a + 1024])), np.float32)
            x[rows[own >= 0], own[own >= 0]] = 1
            dense.append(x)
        out += np.rint(dense[0] @ dense[1].T).astype(np.int64)
    few = times > 0
    few[often] = False
    keep = few[at_r]
    at_r, rows_r = at_r[keep], rows_r[keep]
    order = np.argsort(at_r, kind="stable")
    rows_r = rows_r[order]
    count = np.bincount(at_r, minlength=n)
    first = np.cumsum(count) - count
    keep = few[at_l]
    at_l, rows_l = at_l[keep], rows_l[keep]
    made = np.cumsum(count[at_l])
    a = 0
    while a < len(at_l):
        b = max(a + 1, int(np.searchsorted(made, (made[a - 1] if a else 0) + (4 << 20), side="right")))
        own = count[at_l[a:b]]
        each = row_ids(own)
        place = first[at_l[a:b]][each] + np.arange(len(each)) - (np.cumsum(own) - own)[each]
        out += np.bincount(rows_l[a:b][each] * len(right) + rows_r[place], minlength=out.size).reshape(out.shape)
        a = b
    return out


def full_sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame, how: Banding, *, text: str, key: str) -> DataFrame:
    """``node, set`` of the classes in ``nodes``, made from the texts of the rows that gave them their ids.

    Ids only choose the texts to read again; sets meet classes by their digests, so texts that share an id, or have none,
    are each read once.
    """
    need = nodes.join(classes.select("node", "d1", "d2", "id"), "node")
    asked = need.select("id").distinct()
    texts = docs.select(docs[key].cast("long").alias("doc"), docs[text].alias("body")).join(asked, F.col("doc").eqNullSafe(F.col("id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(_column(batch, "body")):
                sets, sizes = shingle_sets(data, offsets, how.words)
                x, y = digests(sets, sizes)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                one = np.unique(np.stack([x, y], 1), axis=0, return_index=True)[1] if len(x) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[one]), pa.array(y[one]), pa.array([sets[ends[i] : ends[i + 1]].tobytes() for i in one], pa.binary())], names=["d1", "d2", "set"])

    made = texts.select("body").mapInArrow(lean(run), "d1 long, d2 long, set binary").dropDuplicates(["d1", "d2"])
    return made.join(need.select("node", "d1", "d2"), ["d1", "d2"]).select("node", "set")


def family_links(family: DataFrame, labels: DataFrame, sets: DataFrame, how: Banding) -> DataFrame:
    """``a, b`` of different labels that are similar enough, one pair at least for each two labels that have such a pair in a family.

    The members outside a family's largest component are dealt into blocks, and so are those inside it; each block of the
    former is held against all blocks on full sets.
    """
    members = _with_label(family, labels).join(sets.select("node", (F.octet_length("set") / 8).cast("long").alias("n")), "node").withColumn("n", F.greatest("n", F.lit(how.least)))
    by = members.groupBy("family", "label").agg(F.sum("n").alias("n"))
    top = by.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("top"), F.sum("n").alias("every"), F.max("n").alias("inner"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    parts = lambda n: F.greatest(F.ceil(n / how.block), F.least(F.lit(how.deal), F.ceil(n * 32 / how.block))).cast("long")
    top = top.select("family", "top", parts(F.col("every") - F.col("inner")).alias("p"), parts(F.col("inner")).alias("q"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")  # one family may hold most members
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(top.select("*", salts), ["family", "salt"]).withColumn("outside", F.col("label") != F.col("top"))
    dealt = dealt.withColumn("block", F.when(F.col("outside"), F.pmod(F.xxhash64("node"), "p")).otherwise(F.col("p") + F.pmod(F.xxhash64("node"), "q")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("outside"), F.col("p") + F.col("q")).otherwise(F.col("p")) - 1)))
    dealt = dealt.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label")

    def compare(table: pa.Table) -> pa.Table:
        block, node, label = (table.column(c).to_numpy() for c in ("block", "node", "label"))
        found = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(left), 1024):
            part = left[at : at + 1024]
            if not len(right):
                break
            both = shared_counts([found[x] for x in part], [found[x] for x in right])
            whole = np.array([len(found[x]) for x in part])[:, None] + np.array([len(found[x]) for x in right])[None, :]
            x, y = np.nonzero((100 * both >= how.percent * (whole - both)) & (label[part][:, None] != label[right][None, :]))
            a.append(part[x])
            b.append(right[y])
        a, b = np.concatenate(a), np.concatenate(b)
        ends = np.stack([np.minimum(label[a], label[b]), np.maximum(label[a], label[b])], 1)
        one = np.unique(ends, axis=0, return_index=True)[1] if len(a) else np.zeros(0, np.int64)
        return pa.table({"a": pa.array(node[a[one]], pa.int64()), "b": pa.array(node[b[one]], pa.int64())})

    return dealt.join(sets, "node").groupBy("family", "i", "j").applyInArrow(compare, "a long, b long")


def confirm(pairs: DataFrame, sets: DataFrame, how: Banding) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    of = lambda x: sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (_column(batch, c).to_pylist() for c in ("set_a", "set_b"))
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(left, right)):
                known, mine = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                place = np.searchsorted(known, mine)
                place[place == len(known)] = 0
                both = int((known[place] == mine).sum())
                ok[i] = 100 * both >= how.percent * (len(known) + len(mine) - both)
            yield pa.RecordBatch.from_arrays([_column(batch, c).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    both = pairs.select("a", "b").join(of("b"), "b").join(of("a"), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(lean(run), "a long, b long")


def _labelled(docs: DataFrame, shelf: Shelf, how: Banding, *, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """``id, n, d1, d2`` of each row and ``d1, d2, id, label`` of each class: the label is common to all that links reach."""
    text_batches(docs.sparkSession)
    rows = shelf.put(profiles(docs, text=text, key=key, how=how))
    classes = shelf.put(set_classes(rows))
    wide = classes.where("n > 2")  # two sets of which one has at most two elements reach 0.75 only if they are equal
    keys = shelf.put(table_keys(wide, how))
    compared = shelf.put(hub_pairs(keys, how))
    shared = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    sets = shelf.put(full_sets(keys.join(shared.select("key"), "key", "left_semi").select("node").distinct(), docs, classes, how, text=text, key=key))
    labels = components(confirm(compared, sets, how), shelf)
    mixed = shelf.put(mixed_buckets(keys, labels))
    family = families(mixed, shelf, how)
    known = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = shelf.put(small_pairs(mixed, family, how).join(known, ["a", "b"], "left_anti"))
    labels = joined(labels, shelf.put(family_links(family, labels, sets, how).union(confirm(rest, sets, how))), shelf)
    named = shelf.put(classes.select("node", "d1", "d2", "id").join(labels, "node", "left").select("d1", "d2", "id", F.coalesce("label", "node").alias("label")))
    for done in (classes, keys, compared, sets, mixed, rest):
        shelf.drop(done)
    return rows.select("id", "n", "d1", "d2"), named


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", how: Banding = Banding()) -> DataFrame:
    """``key, n_shingles, component_id, kept`` of each row.

    ``component_id`` is the smallest key that is reachable over links, ``kept`` says whether it is the row's own. A null or
    empty text, or one without words, has an empty set and is linked with nothing. A row with a null key is linked like
    others but never names a component; alone its component is null and it is kept. Rows that repeat a key are nodes
    of their own text. An empty table gives an empty one. Only the two columns are read.
    """
    rows, named = _labelled(docs, Shelf(docs.sparkSession, "near"), how, text=text, key=key)
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    of_class = named.join(least, "label").select("d1", "d2", "component_id")
    out = rows.join(of_class, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, *, text: str = "text", key: str = "doc_id", how: Banding = Banding()) -> DataFrame:
    """The rows of ``docs`` of which one stays from each component: the one with the smallest key, nulls last.

    Of rows that repeat both key and text one stays. Rows without words are linked with nothing, so all of them stay. The
    texts are shuffled once, by key and digest; repeats go before that shuffle.
    """
    shelf = Shelf(docs.sparkSession, "near")
    _, named = _labelled(docs, shelf, how, text=text, key=key)
    first = named.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "d1", "d2")).alias("x")).select("x.id", "x.d1", "x.d2")
    d1, d2, at = (free_name(docs, c) for c in ("d1", "d2", "at"))
    chosen = first.select(F.col("id").alias(at), F.col("d1").alias(d1), F.col("d2").alias(d2))
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(d1, T.LongType()), T.StructField(d2, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digests(*shingle_sets(data, offsets, how.words)) for _, _, data, offsets in slices(_column(batch, text))]
            marks = [np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, marks)], names=[*names, d1, d2])

    marked = docs.mapInArrow(lean(run), schema).withColumn(at, F.col(key).cast("long"))
    no_set = (F.col(d1) == 0) & (F.col(d2) == 0)
    full = marked.where(~no_set).dropDuplicates([at, d1, d2])
    same = [full[c].eqNullSafe(chosen[c]) for c in (at, d1, d2)]
    stay = full.join(chosen, same[0] & same[1] & same[2], "left_semi")
    return stay.select(*names).union(marked.where(no_set).select(*names))
