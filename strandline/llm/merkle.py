"""A Merkle manifest of a table.

Every row is a leaf; the leaves of a group (a language) are hashed in pairs, level by
level, up to the group's root, and the groups' roots likewise up to one root. Rows are
ranked inside their group by ranges, so that no task sorts a group. Ranked leaves are laid
into arrays of ``BLOCK``; ``sequence``, ``slice`` and ``transform`` make a level from the one
below and ``aggregate`` goes on to the top of the array. The roots of full arrays are the
nodes of the next round, until each group is one node: a round for each power of ``BLOCK``. Then the
paths of siblings go down again, one array of them a block, and rows check themselves
against the root. All of it is DataFrame functions; only the number of rounds comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import ranked
from .shelf import Shelf

#: Nodes of an array: a power of two. A block of leaves is a row of about 200 kB.
BITS = 9
BLOCK = 1 << BITS

#: The columns that make a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = "array<struct<left:boolean,h:string>>"


def sha(x: Column) -> Column:
    return F.sha2(x, 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value; so no two lists of fields read alike."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    return sha(F.concat(*(field(v) for v in values)))


def group_key(value: Column) -> Column:
    """A string that is never null, with null before all others and those in order of their bytes."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def level_above(level: Column) -> Column:
    """The hashes of every two neighbours; a last one alone is hashed by itself."""
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(runs, lambda j: sha(F.array_join(F.slice(level, 2 * j + 1, 2), "")))


def levels(nodes: Column, count: Column) -> Column:
    """The array of nodes and ``count`` levels above it."""
    start = F.array(nodes)
    steps = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, lambda done, _: F.concat(done, F.array(level_above(F.element_at(done, -1)))))


def siblings(every: Column, slot: Column) -> Column:
    """The way from a place of the lowest level to the top: for each level the sibling, null if there is none, and whether it is on the left."""

    def step(i: Column) -> Column:
        at = F.call_function("shiftright", slot, i)
        return F.struct((at % 2 == 1).alias("left"), F.get(F.get(every, i), at.bitwiseXOR(F.lit(1))).alias("h"))

    n = F.size(every) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), step)).otherwise(F.array().cast(_STEP))


def blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """``g, block, n, levels, payload``: nodes ``g, pos, n, h`` in arrays, collapsed as far as an array reaches.

    A group that fits one array is collapsed to its root; an array of a larger group always by ``BITS`` levels, also the last
    and shorter one, whose lone nodes are hashed by themselves.
    """
    slot = F.pmod("pos", F.lit(BLOCK)).cast("int").alias("slot")
    row = F.struct(slot, "h", *payload)
    by = nodes.groupBy("g", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(row)).alias("x"))
    depth = F.least(F.lit(BITS), F.ceil(F.log2(F.col("n").cast("double")))).cast("int")
    made = by.withColumn("levels", levels(F.col("x.h"), depth))
    return made.select("g", "block", "n", "levels", *(F.col(f"x.{c}").alias(c) for c in payload))


def grow(nodes: DataFrame, payload: list[str], shelf: Shelf) -> tuple[list[DataFrame], DataFrame]:
    """The rounds' blocks, lowest first, and ``g, h``: the root of each group."""
    tables = [shelf.put(blocks(nodes, payload))]
    root = F.get(F.element_at("levels", -1), F.lit(0)).alias("h")
    while True:
        up = tables[-1].select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), root)
        if (up.agg(F.max("n")).first()[0] or 1) <= 1:
            return tables, up.select("g", "h")
        tables.append(shelf.put(blocks(up, [])))


def paths(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """``g, block, path`` and the other columns of ``above``, for the lowest blocks: the steps from a block's root up, ending in the group's ``path`` of ``above``."""
    down = above.withColumn("block", F.lit(0).cast("long"))
    rest = [c for c in above.columns if c not in ("g", "path")]
    for t in reversed(tables[1:]):
        slots = F.posexplode(F.get("levels", F.lit(0))).alias("slot", "h")
        each = t.select("g", "block", "levels", slots).select("g", "block", "slot", siblings(F.col("levels"), F.col("slot")).alias("own"))
        down = each.join(down, ["g", "block"]).select("g", (F.col("block") * BLOCK + F.col("slot")).alias("block"), F.concat("own", "path").alias("path"), *rest)
    return down


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda a, s: sha(F.when(s["h"].isNull(), a).when(s["left"], F.concat(s["h"], a)).otherwise(F.concat(a, s["h"]))))


def manifest(docs: DataFrame, *, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, changed: dict[str, Column] | None = None) -> DataFrame:
    """``key, leaf, subroot, root, path, folded_root, verified`` of every row.

    Leaves ascend by ``key`` inside their group, null first; rows that repeat a key stand in order of their leaves, and equal
    rows are interchangeable. Groups are in order of their bytes, null first. ``path`` holds the siblings from the leaf
    to the root; ``folded_root`` is made from them and the leaf of the row as ``changed`` has it (column to value), or as it
    is; ``verified`` says whether that is the root. Null fields and empty or long texts are fields like others. An empty
    table gives no row. Only ``fields`` are read, so further columns don't matter.
    """
    shelf = Shelf(docs.sparkSession, "merkle")
    changed = changed or {}
    leaf, other = leaf_of([docs[c] for c in fields]), leaf_of([changed.get(c, docs[c]) for c in fields])
    rows = shelf.put(docs.select(group_key(docs[group]).alias("g"), docs[key].alias("id"), leaf.alias("h"), other.alias("other")))
    rows = rows.withColumn("other", F.when(F.col("other") != F.col("h"), F.col("other")))
    tables, subroots = grow(ranked(rows, ["id", "h"], shelf), ["id", "other"], shelf)
    tops = shelf.put(subroots)
    whole = ranked(tops.select(F.lit("").alias("g"), F.col("g").alias("name"), "h"), ["name"], shelf)
    top_tables, root = grow(whole, ["name"], shelf)
    above = paths(top_tables, root.select("g", F.array().cast(_STEP).alias("path"), F.col("h").alias("root")))
    names = F.explode(F.arrays_zip("name", F.get("levels", F.lit(0)).alias("h"), F.sequence(F.lit(0), F.size("name") - 1).alias("slot"))).alias("x")
    each = top_tables[0].select("g", "block", "levels", names).join(above, ["g", "block"])
    step = F.concat(siblings(F.col("levels"), F.col("x.slot")), F.col("path"))
    of_group = shelf.put(each.select(F.col("x.name").alias("g"), step.alias("path"), F.col("x.h").alias("subroot"), "root"))
    up = paths(tables, of_group)
    leaves = F.explode(F.arrays_zip("id", F.get("levels", F.lit(0)).alias("leaf"), "other", F.sequence(F.lit(0), F.size("id") - 1).alias("slot"))).alias("x")
    out = tables[0].join(up, ["g", "block"]).select("levels", "path", "subroot", "root", leaves)
    out = out.select("x.*", "subroot", "root", F.concat(siblings(F.col("levels"), F.col("x.slot")), F.col("path")).alias("path"))
    out = out.withColumn("folded_root", folded(F.coalesce("other", "leaf"), F.col("path")))
    return out.select(F.col("id").alias(key), "leaf", "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def proof(path: Column) -> Column:
    """The hash of all siblings of a path."""
    return sha(F.array_join(F.transform(F.filter(path, lambda s: s["h"].isNotNull()), lambda s: s["h"]), ""))
