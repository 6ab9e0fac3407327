"""Sharding by vector bin packing.

Bytes, tokens and rows are balanced jointly. Equal texts form a group. Groups
that hold a noticeable share of the table are items of their own (cut into
pieces where one is more than ``piece`` of a shard), the many small groups are
gathered by hash into a fixed number of lots. So the number of items is bounded
by parameters at any table size, and the packing of items, largest first, each
to the shard where the dot product of its vector with the residual capacity is
highest, takes one small numpy loop on the driver. Then single items move while
that narrows the loads' spread in all three dimensions together. Rows are ranked
inside each group by ranges of the whole table; a group's pieces are stretches of its
ranks, so they are equal however often a row repeats, and items follow each other
inside a shard: no task ever sorts a shard, a group or a lot.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import n_words
from .ranks import ranked
from .shelf import Shelf


@dataclass(frozen=True)
class Packing:
    """``lots`` items by hash a shard; a group above ``own`` of a shard is its own item, one above ``piece`` of a shard is cut into eighths of that."""

    shards: int = 24
    lots: int = 1024
    own: float = 1 / 64
    piece: float = 1 / 4


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item: items by falling largest share, each to the highest dot product with what is left.

    A shard that the item would fill beyond its share in any dimension is taken only if all are; the one with
    the least overflow then. Ties go to the lower shard number.
    """
    n = len(vectors)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    total = vectors.sum(0)
    share = vectors / np.where(total > 0, total, 1) * shards  # 1: all of a shard
    left = np.ones((shards, vectors.shape[1]))
    for i in np.lexsort((np.arange(n), -share.sum(1), -share.max(1))):
        item = share[i]
        over = np.maximum(item - left, 0).max(1)
        fits = over <= 1e-12
        score = left @ item
        best = int(np.argmax(np.where(fits, score, -np.inf))) if fits.any() else int(np.lexsort((-score, over))[0])
        out[i] = best
        left[best] -= item
    return level(out, share, shards)


def level(at: np.ndarray, share: np.ndarray, shards: int, first: float = 3.0, least: float = 1e-6) -> np.ndarray:
    """Move or swap single items while that lowers the sum of squares of all loads, in all dimensions, by ``least`` or more.

    The first dimension, which the law names, counts ``first`` times. The shard farthest from the mean that has such an
    item or pair goes first. The sum falls with each step, so this ends.
    """
    share = share * np.array([first, *[1.0] * (share.shape[1] - 1)])
    mean = share.sum(0) / shards
    loads = np.zeros((shards, share.shape[1]))
    np.add.at(loads, at, share)

    def step(one: int) -> tuple[float, int, int, int]:
        """The best change at a shard: its gain, the item, the other shard, and the item that comes back or -1."""
        own, best = np.flatnonzero(at == one), (-least, -1, -1, -1)
        for other in range(shards):
            if other == one or not len(own):
                continue
            gap, theirs = loads[other] - loads[one], np.flatnonzero(at == other)
            tries = [(share[own], np.full(len(own), -1))]
            if len(theirs):  # the items there whose exchange would level the first dimension best
                theirs = theirs[np.argsort(share[theirs, 0], kind="stable")]
                near = np.searchsorted(share[theirs, 0], share[own, 0] + gap[0] / 2)
                for j in (np.maximum(near - 1, 0), np.minimum(near, len(theirs) - 1)):
                    tries.append((share[own] - share[theirs[j]], theirs[j]))
            for x, back in tries:
                change = 2 * (x @ gap + (x * x).sum(1))
                i = int(change.argmin())
                if change[i] < best[0]:
                    best = (float(change[i]), int(own[i]), other, int(back[i]))
        return best

    while True:
        for one in np.argsort(-np.abs(loads - mean).max(1), kind="stable").tolist():
            _, i, other, back = step(one)
            if i >= 0:
                x = share[i] - (share[back] if back >= 0 else 0)
                loads[one] -= x
                loads[other] += x
                at[i] = other
                if back >= 0:
                    at[back] = one
                break
        else:
            return at


def shard(docs: DataFrame, *, text: str = "text", key: str = "doc_id", plan: Packing = Packing()) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` of every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 8 (a null text has none and is in the group of empty texts; its CRC is 0).
    Null keys and repeated rows are rows like any other; rows with equal key and text are numbered in any order. Rows of an
    empty table: none. Only ``key`` and ``text`` are read, so further columns may have any name.
    """
    spark = docs.sparkSession
    body = F.coalesce(docs[text], F.lit(""))
    shelf = Shelf(spark, "shard")
    rows = shelf.put(docs.select(
        docs[key].alias("id"),
        (F.octet_length(body) + 8).cast("long").alias("bytes"),
        n_words(docs[text]).alias("tokens"),
        F.crc32(body).alias("crc"),
        F.xxhash64(body).alias("text_hash"),
    ))
    sums = [F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    whole = rows.agg(*sums).first()
    total = [float(whole[c] or 0) for c in ("bytes", "tokens", "rows")]
    capacity = [max(t / plan.shards, 1e-9) for t in total]
    share = lambda: F.greatest(*(F.col(c) / F.lit(v) for c, v in zip(("bytes", "tokens", "rows"), capacity)))
    # At most 3 * shards / own groups can pass this.
    large = rows.groupBy("text_hash", "crc").agg(*sums).where(share() > plan.own).select("text_hash", "crc", "bytes", "tokens", "rows", F.ceil(share() / F.lit(plan.piece)).cast("int").alias("pieces")).collect()
    lots = plan.shards * plan.lots
    own = spark.createDataFrame([(r.text_hash, r.crc, f"g/{r.text_hash}/{r.crc}") for r in large], "text_hash long, crc long, own string")
    lot = F.concat_ws("/", F.lit("l"), F.pmod(F.col("text_hash"), F.lit(lots)))
    rows = shelf.put(rows.join(F.broadcast(own), ["text_hash", "crc"], "left").select("id", "bytes", "tokens", "crc", F.coalesce("own", lot).alias("g")))
    # An item is a stretch of a group's ranks: its name, the first rank and the row's vector. Texts of a group are equal.
    items = [(r["g"], 0, (r["bytes"], r["tokens"], r["rows"])) for r in rows.where(F.col("g").startswith("l/")).groupBy("g").agg(*sums).collect()]  # bounded by lots
    for r in large:
        k = min(r["pieces"] * (8 if r["pieces"] > 1 else 1), r["rows"])  # a group that is cut at all is cut fine enough to level the loads
        starts = [i * r["rows"] // k for i in range(k + 1)]
        items += [(f"g/{r['text_hash']}/{r['crc']}", a, tuple(r[c] * (b - a) / r["rows"] for c in ("bytes", "tokens", "rows"))) for a, b in zip(starts, starts[1:])]
    items.sort()
    shards = place(np.array([x[2] for x in items], float).reshape(-1, 3), plan.shards)
    next_slot, places = [0] * plan.shards, {}
    for (g, first, vector), s in zip(items, shards.tolist()):
        places.setdefault(g, []).append((first, s, next_slot[s] - first))
        next_slot[s] += round(vector[2])
    at = spark.createDataFrame(list(places.items()), "g string, parts array<struct<first:long,shard:int,shift:long>>")
    found = ranked(rows, ["id", "crc", "bytes"], shelf).join(F.broadcast(at), "g")
    part = F.element_at(F.filter("parts", lambda x: x["first"] <= F.col("pos")), -1)
    return found.withColumn("part", part).select(
        F.col("id").alias(key),
        F.col("bytes").alias("size"),
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("part.shard").alias("shard"),
        (F.col("part.shift") + F.col("pos")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )
