"""Person/concept graph: nodes, edges, upsert and the queries on it.

Guests and concepts belong to an episode and are only copied to its chunks. So
what needs sums over chunks (frequencies, the upsert, mentions) is computed for
episodes with their number of chunks, and edge rows for chunks are made only
where they are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..params import Params
from ..plans.sizes import sent_if_small
from ..sources.shelf import Shelf
from .chunk import chunk_bounds

_NONE = "array<string>"


def _clean(names: Column, lower: bool) -> Column:
    kept = F.transform(F.coalesce(names, F.array().cast(_NONE)), lambda x: t.strip(F.lower(x) if lower else x))
    return F.filter(kept, lambda x: x.isNotNull() & (x != ""))


def episodes(chunks: DataFrame, p: Params) -> DataFrame:
    """``episode_id, guests, concepts, n_chunks, last_chunk, chaos``: a row for each episode of a chunk table.

    The guest list is that of the first chunk that has one; the concepts are those of the chunks, which agree; chaos is a
    score above the cut or the marker in the id.
    """
    by = chunks.groupBy("episode_id").agg(
        F.min_by("guest_list", F.when(F.col("guest_list").isNotNull(), F.col("chunk_id"))).alias("guest_list"),
        F.min_by("top_concepts", F.when(F.col("top_concepts").isNotNull(), F.col("chunk_id"))).alias("top_concepts"),
        F.count(F.lit(1)).alias("n_chunks"),
        F.max("chunk_id").alias("last_chunk"),
        F.max("episode_chaos").alias("score"),
    )
    return by.select("episode_id", _clean(F.col("guest_list"), False).alias("guests"), _clean(F.col("top_concepts"), True).alias("concepts"), "n_chunks", "last_chunk", chaos_flag(F.col("score"), F.col("episode_id"), p).alias("chaos"))


def episodes_of(gold: DataFrame, p: Params, *, key: str = "episode_id", text: str = "content_body", guests: str = "nlp_guests") -> DataFrame:
    """The rows of ``episodes`` without a chunk table, from gold rows: chunks are only counted, and nothing is shuffled.

    A text has a chunk if it has a character, so rows are left out by that: a filter on the number would count the chunks twice.
    """
    body = t.prefix(F.col(text), p.chunk_chars)
    lengths = F.transform(p.split(body), lambda x: F.length(x))
    counted = gold.where(F.length(body) > 0).select(
        F.col(key).alias("episode_id"),
        _clean(F.col(guests), False).alias("guests"),
        t.let(lengths, lambda n: F.size(chunk_bounds(n, p))).cast("long").alias("n_chunks"),
        chaos_flag(F.col("chaos_score"), F.col(key), p).alias("chaos"),
        _clean(F.col("top_concepts"), True).alias("concepts"),
    )
    # The greatest id as a string: ordinals have four digits, or more beyond 9999, which sort lower.
    last = F.format_string("%s-%04d", F.col("episode_id").cast("string"), F.least(F.col("n_chunks") - 1, F.lit(9999)))
    return counted.select("episode_id", "guests", "concepts", "n_chunks", last.alias("last_chunk"), "chaos")


def chaos_flag(score: Column, episode: Column, p: Params) -> Column:
    return F.coalesce(score > p.chaos_cut, F.lit(False)) | F.contains(episode.cast("string"), F.lit(p.chaos_marker))


def frequent(episodes_: DataFrame, column: str, least: int) -> DataFrame:
    """``id, n`` of the names in at least ``least`` chunks."""
    each = episodes_.select(F.explode(column).alias("id"), "n_chunks")
    return each.groupBy("id").agg(F.sum("n_chunks").alias("n")).where(F.col("n") >= least)


def valid_episodes(episodes_: DataFrame, p: Params, nodes_: DataFrame | None = None) -> DataFrame:
    """Episodes with only the valid guests and concepts, in their order; those without a valid concept have no edge.

    ``nodes_`` are the episodes' nodes if they are there already, else they are written once. All names of an episode meet them in
    one join and bring the rest of its row along, so that nothing has to be joined back.
    """
    names = Shelf(episodes_.sparkSession, "nodes").put(nodes(episodes_, p)) if nodes_ is None else nodes_
    own = ["episode_id", "n_chunks", "last_chunk", "chaos"]
    listed = lambda column, kind: F.transform(column, lambda x, i: F.struct(F.lit(kind).alias("type"), i.alias("pos"), x.alias("id")))
    each = episodes_.where(F.col("episode_id").isNotNull()).select(*own, F.explode(F.concat(listed("guests", "PERSON"), listed("concepts", "CONCEPT"))).alias("x")).select(*own, "x.*")
    kept = each.join(sent_if_small(names.select("id", "type")), ["id", "type"], "left_semi").groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "type"))).alias("x"))
    of = lambda kind: F.transform(F.filter("x", lambda x: x["type"] == kind), lambda x: x["id"])
    return kept.select(*own, of("CONCEPT").alias("concepts"), of("PERSON").alias("guests")).where(F.size("concepts") > 0)


def nodes(episodes_: DataFrame, p: Params) -> DataFrame:
    """``id, type`` of the frequent guests and concepts."""
    part = lambda c, least, kind: frequent(episodes_, c, least).select("id", F.lit(kind).alias("type"))
    return part("guests", p.min_guest_rows, "PERSON").union(part("concepts", p.min_concept_rows, "CONCEPT"))


def pairs_in_order(names: Column) -> Column:
    """(a, b) for each pair of names, a before b in the list."""
    return F.flatten(F.transform(names, lambda a, i: F.transform(F.slice(names, i + 2, F.greatest(F.size(names) - i - 1, F.lit(0))), lambda b: F.struct(a.alias("source"), b.alias("target")))))


def discussed(valid: DataFrame) -> DataFrame:
    """A row for each guest and concept of an episode, with what else ``valid`` has."""
    rest = [c for c in valid.columns if c not in ("guests", "concepts")]
    return valid.select(*rest, F.explode("guests").alias("source"), "concepts").select(*rest, "source", F.explode("concepts").alias("target")).withColumns({"type": F.lit("DISCUSSED"), "weight": F.lit(1.0)})


def co_occurring(valid: DataFrame) -> DataFrame:
    """A row for each pair of an episode's concepts in list order."""
    rest = [c for c in valid.columns if c not in ("guests", "concepts")]
    return valid.select(*rest, F.explode(pairs_in_order(F.col("concepts"))).alias("x")).select(*rest, "x.source", "x.target").withColumns({"type": F.lit("CO_OCCURRENCE"), "weight": F.lit(0.5)})


def edges(chunks: DataFrame, valid: DataFrame) -> DataFrame:
    """The edge rows of all chunks: ``source, target, type, chunk_id, chaos, weight``.

    Chunks meet their episode's lists before these are exploded, so the join moves one row for a chunk.
    """
    each = chunks.select("chunk_id", "episode_id").join(valid.select("episode_id", "guests", "concepts", "chaos"), "episode_id").drop("episode_id")
    columns = ["source", "target", "type", "chunk_id", "chaos", "weight"]
    return discussed(each).select(*columns).union(co_occurring(each).select(*columns))


def edges_of(valid: DataFrame) -> DataFrame:
    """The same edge rows from valid episodes alone, with the ids that their chunks have."""
    each = valid.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)))
    each = each.select(F.format_string("%s-%04d", F.col("episode_id").cast("string"), "i").alias("chunk_id"), "guests", "concepts", "chaos")
    columns = ["source", "target", "type", "chunk_id", "chaos", "weight"]
    return discussed(each).select(*columns).union(co_occurring(each).select(*columns))


def folded(valid: DataFrame) -> DataFrame:
    """One row for each ``source, target, type``: ``chunk_id`` and ``chaos`` of the greatest chunk, mentions and weight, which are sums over chunks."""
    columns = ["source", "target", "type", "weight", "n_chunks", "last_chunk", "chaos"]
    rows = discussed(valid).select(*columns).union(co_occurring(valid).select(*columns))
    by = rows.groupBy("source", "target", "type").agg(
        F.max(F.struct("last_chunk", "chaos")).alias("x"),
        F.sum("n_chunks").alias("mentions"),
        F.sum(F.col("n_chunks") * F.col("weight")).alias("weight"),
    )
    return by.select("source", "target", "type", F.col("x.last_chunk").alias("chunk_id"), F.col("x.chaos").alias("chaos"), "mentions", "weight")


def upserted(valid: DataFrame, nodes_: DataFrame | None = None) -> DataFrame:
    """The folded edges both of whose ends are nodes. Without ``nodes_`` they are those of the episodes that ``valid`` was made of: it has no other names."""
    some = folded(valid)
    if nodes_ is None:
        return some
    ends = lambda name, kind: sent_if_small(nodes_.select(F.col("id").alias(name), F.col("type").alias(kind)))
    source_kind = F.when(F.col("type") == "DISCUSSED", "PERSON").otherwise("CONCEPT")
    some = some.withColumns({"source_kind": source_kind, "target_kind": F.lit("CONCEPT")})
    met = some.join(ends("source", "source_kind"), ["source", "source_kind"], "left_semi").join(ends("target", "target_kind"), ["target", "target_kind"], "left_semi")
    return met.select("source", "target", "type", "chunk_id", "chaos", "mentions", "weight")


def merged_nodes(*parts: DataFrame) -> DataFrame:
    """Nodes of all parts, each id once for a type."""
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out.dropDuplicates(["type", "id"])


def topic_authority(upserted_: DataFrame, concept: str, n: int = 5) -> DataFrame:
    """``guest, mentions``: who mentions a concept in the most chunks; ties by name."""
    own = upserted_.where((F.col("type") == "DISCUSSED") & (F.col("target") == concept))
    return own.select(F.col("source").alias("guest"), "mentions").orderBy(F.desc("mentions"), "guest").limit(n)


def chaos_edges(edges_: DataFrame, n: int | None = None) -> DataFrame:
    """``chunk, guest, concept`` of the DISCUSSED edges with chaos, in order if only ``n`` are wanted."""
    own = edges_.where((F.col("type") == "DISCUSSED") & F.col("chaos")).select(F.col("chunk_id").alias("chunk"), F.col("source").alias("guest"), F.col("target").alias("concept"))
    return own if n is None else own.orderBy("chunk", "guest", "concept").limit(n)


def neighbours(edges_: DataFrame, entity: str, n: int | None = 10) -> DataFrame:
    """``entity, rel, connected_to, chunk``: DISCUSSED edges, in both directions, at names that contain ``entity``."""
    own = edges_.where(F.col("type") == "DISCUSSED")
    there = own.select(F.col("source").alias("entity"), F.col("type").alias("rel"), F.col("target").alias("connected_to"), F.col("chunk_id").alias("chunk"))
    back = own.select(F.col("target").alias("entity"), F.col("type").alias("rel"), F.col("source").alias("connected_to"), F.col("chunk_id").alias("chunk"))
    found = there.union(back).where(F.contains(F.lower("entity"), F.lit(entity.lower())))
    return found if n is None else found.orderBy("entity", "connected_to", "chunk").limit(n)


def shortest_path(edges_: DataFrame, start: str, end: str, hops: int = 4) -> list[str] | None:
    """The ids on a shortest DISCUSSED path of at most ``hops``, the least in order of ids; nothing if there is none.

    Breadth-first search by joins from both ends, which meet in the middle: the smaller frontier goes on, and each keeps one
    path for each new node, the least one.
    """
    own = edges_.where(F.col("type") == "DISCUSSED").select("source", "target").distinct()
    shelf = Shelf(edges_.sparkSession, "paths")
    links = shelf.put(own)
    return _search(links.union(links.select("target", "source")).toDF("at", "next"), shelf, start, end, hops)


def path_rows(edges_: DataFrame, start: str, end: str, hops: int = 4) -> DataFrame:
    """``hop, id`` of ``shortest_path``; no row without one."""
    return edges_.sparkSession.createDataFrame(list(enumerate(shortest_path(edges_, start, end, hops) or [])), "hop int, id string")


def _search(links: DataFrame, shelf: Shelf, start: str, end: str, hops: int) -> list[str] | None:
    if start == end:
        return [start] if links.where(F.col("at") == start).limit(1).count() else None
    spark = links.sparkSession
    sides = []
    for name in (start, end):
        level = spark.createDataFrame([(name, [name])], "at string, path array<string>")
        sides.append({"level": level, "seen": level.select("at"), "n": 1})
    for _ in range(hops):
        go = min((0, 1), key=lambda i: sides[i]["n"])
        own = sides[go]
        longer = F.concat("path", F.array("next")) if go == 0 else F.concat(F.array("next"), "path")
        step = links.join(own["level"], "at").select("next", longer.alias("path"))
        new = shelf.put(step.join(own["seen"], step["next"] == own["seen"]["at"], "left_anti").groupBy(F.col("next").alias("at")).agg(F.min("path").alias("path")))
        own["level"], own["seen"], own["n"] = new, own["seen"].union(new.select("at")), new.count()
        if not own["n"]:
            return None
        there, back = (side["level"].select("at", F.col("path").alias(name)) for side, name in zip(sides, ("there", "back")))
        # Both newest frontiers hold all nodes at their distances, so the first meeting is on a shortest path.
        met = there.join(back, "at").select(F.concat("there", F.slice("back", 2, F.greatest(F.size("back") - 1, F.lit(0)))).alias("path")).agg(F.min("path").alias("path")).first()
        if met.path is not None:
            return list(met.path)
    return None
