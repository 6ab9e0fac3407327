"""All questions at once: the agent's loop as rounds over a table of states.

``Agent.run`` answers one question from the driver. Here each round takes all questions that
are still open through one plan: names of the graph are found in the questions by an
automaton, every template is one join for all its questions, vectors of all questions are
searched together, and the model is called in the tasks. A question that is answered leaves;
the others go on with their new wording, so there are as many rounds as one question
can have, whatever the number of questions. Steps and answers are those of ``Agent.run``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.providers import Chat, ExtractiveChat, safe
from ..sources.shelf import Shelf
from . import graph, lexicon, vectors
from .agent import ASKS

_CONTEXT = "array<struct<text:string,chunk_id:string,chaos:double>>"
_STATE = f"id {{}}, question string, context {_CONTEXT}, grade string, attempts int, steps array<string>, answer string, done boolean"


def planned_each(questions: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, template, a, b`` for each ``id, question``: what ``agent.planned`` picks, for all questions in one join."""
    names = nodes.where(F.length("id") > 2).select(F.col("id").alias("name"), "type", F.lower("id").alias("phrase"))
    low = questions.select("id", F.lower("question").alias("text"))
    hits = lexicon.hits(low, names, key="id").join(names, "phrase")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.length("name")), "name", "type"))
    two = hits.withColumn("place", place).where("place <= 2").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "name", "type"))).alias("found"))
    each = low.join(two, "id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<place:int,name:string,type:string>>")))
    asks = {k: t.contains_any(F.coalesce("text", F.lit("")), w) for k, w in ASKS.items()}
    concept = F.get(F.filter("found", lambda x: x["type"] == "CONCEPT"), F.lit(0))["name"]
    first, second = (F.get("found", F.lit(i))["name"] for i in (0, 1))
    none = F.lit(None).cast("string")
    pick = lambda kind, a=none, b=none: F.struct(F.lit(kind).alias("template"), a.alias("a"), b.alias("b"))
    plan = F.when((F.size("found") == 2) & asks["path"], pick("path", first, second)).when(asks["chaos"], pick("chaos"))
    plan = plan.when(concept.isNotNull() & asks["authority"], pick("authority", concept)).when(F.size("found") > 0, pick("neighbours", first)).otherwise(pick("persons"))
    return each.select("id", plan.alias("x")).select("id", "x.*")


def paths_each(edges: DataFrame, pairs: DataFrame, hops: int = 4) -> DataFrame:
    """``a, b, path``: ``graph.shortest_path`` for all pairs at once; pairs without a path have no row."""
    shelf = Shelf(edges.sparkSession, "paths")
    own = edges.where(F.col("type") == "DISCUSSED").select(F.col("source").alias("at"), F.col("target").alias("next")).where("at IS NOT NULL AND next IS NOT NULL")
    links = shelf.put(own.union(own.select("next", "at")).distinct())
    pairs = pairs.select("a", "b").distinct()
    same = pairs.where("a = b").join(links.select(F.col("at").alias("a")).distinct(), "a", "left_semi").select("a", "b", F.array("a").alias("path"))
    found = [shelf.put(same)]
    sides = [pairs.where("a <> b").select("a", "b", F.col(c).alias("at"), F.array(c).alias("path")) for c in ("a", "b")]
    seen = [s.select("a", "b", "at") for s in sides]
    for hop in range(hops):
        go = hop % 2
        longer = F.concat("path", F.array("next")) if go == 0 else F.concat(F.array("next"), "path")
        step = links.join(sides[go], "at").select("a", "b", F.col("next").alias("at"), longer.alias("path"))
        new = shelf.put(step.join(seen[go], ["a", "b", "at"], "left_anti").groupBy("a", "b", "at").agg(F.min("path").alias("path")))
        sides[go], seen[go] = new, seen[go].union(new.select("a", "b", "at"))
        there, back = sides[0].withColumnRenamed("path", "there"), sides[1].withColumnRenamed("path", "back")
        met = F.concat("there", F.slice("back", 2, F.greatest(F.size("back") - 1, F.lit(0))))
        ready = shelf.put(there.join(back, ["a", "b", "at"]).groupBy("a", "b").agg(F.min(met).alias("path")))
        found.append(ready)
        sides = [s.join(ready.select("a", "b"), ["a", "b"], "left_anti") for s in sides]
        if not new.limit(1).count():
            break
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def facts_each(tables: dict[str, DataFrame], plans: DataFrame, *, near: int = 10, who: int = 5) -> DataFrame:
    """``id, facts``: the graph's facts for each plan, in the order of its template; plans without any have no row."""
    text = lambda *names: F.concat(F.lit("Graph Fact: "), t.fact(list(names)))
    asked = lambda kind, *by: plans.where(F.col("template") == kind).select("id", *by)
    top = lambda by, order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    parts = []
    if "edges" in tables:
        edges = tables["edges"]
        links = graph.neighbours(edges, "", None).where("entity IS NOT NULL")
        some = asked("neighbours", F.lower("a").alias("phrase"))
        names = links.select(F.col("entity").alias("name")).distinct()
        meant = lexicon.hits(names.select("name", F.lower("name").alias("text")), some, key="name").select(F.col("name").alias("entity"), "phrase")
        place = top(["phrase"], ["entity", "connected_to", "chunk"])
        facts = links.join(meant, "entity").withColumn("place", place).where(F.col("place") <= near).select("phrase", "place", text("entity", "rel", "connected_to", "chunk").alias("text"))
        parts.append(some.join(facts, "phrase").select("id", "place", "text"))
        one = graph.chaos_edges(edges, 1).select(F.lit(1).alias("place"), text("chunk", "guest", "concept").alias("text"))
        parts.append(asked("chaos").withColumn("place", F.lit(1)).join(F.broadcast(one), "place").select("id", "place", "text"))  # one row
        pairs = asked("path", "a", "b")
        steps = paths_each(edges, pairs).select("a", "b", F.posexplode("path").alias("hop", "step"))
        steps = steps.withColumnRenamed("step", "name").select("a", "b", (F.col("hop") + 1).alias("place"), F.concat(F.lit("Graph Fact: hop: "), F.col("hop").cast("string"), F.lit(" | id: "), "name").alias("text"))
        parts.append(pairs.join(steps, ["a", "b"]).select("id", "place", "text"))
    if "upserted" in tables:
        some = asked("authority", "a")
        own = tables["upserted"].where(F.col("type") == "DISCUSSED").join(some.select(F.col("a").alias("target")).distinct(), "target", "left_semi").select(F.col("target").alias("a"), F.col("source").alias("guest"), "mentions")
        facts = own.withColumn("place", top(["a"], [F.desc("mentions"), "guest"])).where(F.col("place") <= who).select("a", "place", text("guest", "mentions").alias("text"))
        parts.append(some.join(facts, "a").select("id", "place", "text"))
    if "nodes" in tables:
        one = tables["nodes"].where("type = 'PERSON'").select("id").orderBy("id").limit(1).select(F.lit(1).alias("place"), text("id").alias("text"))
        parts.append(asked("persons").withColumn("place", F.lit(1)).join(F.broadcast(one), "place").select("id", "place", "text"))  # one row
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    item = F.struct("text", F.lit("GRAPH").alias("chunk_id"), F.lit(0.0).alias("chaos"))
    return every.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", item.alias("item")))), lambda x: x["item"]).alias("facts"))


def answered(tables: dict[str, DataFrame], questions: DataFrame, embed: Callable[[DataFrame], DataFrame], *, chat: Chat | None = None, hits: int = 3, most_attempts: int = 3) -> DataFrame:
    """``id, question, context, grade, attempts, steps, answer`` of each ``id, question``, as ``Agent.run`` ends for each.

    ``tables`` are ``nodes, edges, upserted`` and ``vectors`` (``chunk_id``, each once, ``text_content, episode_chaos, vector``); one
    that is missing finds nothing. ``embed`` adds ``vector`` to rows of ``id, question``. ``id`` tells questions apart; a null question
    is an empty one. ``chat`` is called in the tasks and its errors become its answer.
    """
    chat = chat or ExtractiveChat()
    shelf = Shelf(questions.sparkSession, "answers")
    asked = shelf.put(questions.select("id", F.coalesce("question", F.lit("")).alias("question")))
    kind = asked.schema["id"].dataType.simpleString()
    nodes = tables.get("nodes", questions.sparkSession.createDataFrame([], "id string, type string"))
    facts = shelf.put(facts_each(tables, shelf.put(planned_each(asked, nodes)))) if {"nodes", "edges", "upserted"} & tables.keys() else None
    steps = F.array(F.lit("cypher_gen"))
    rows, ready = asked.select("id", "question", F.lit(0).alias("attempts"), steps.alias("steps")), []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in batch.to_pylist():
                context, question = s["context"] or [], s["question"]
                got = safe(lambda: chat("grade", question, context, [])) if context else "NO"  # noqa: B023
                s["grade"] = "useful" if "YES" in got.upper() else "not_useful"
                s["steps"] += ["retrieval", "grade"]
                s["done"] = s["grade"] == "useful" or s["attempts"] >= most_attempts
                s["answer"] = None
                if s["done"]:
                    s["answer"] = safe(lambda: chat("answer", question, context, []))  # noqa: B023
                    s["steps"] += ["generate"]
                else:
                    s["question"] = safe(lambda: chat("rewrite", question, [], [])).strip()  # noqa: B023
                    s["attempts"] += 1
                    s["steps"] += ["rewrite"]
                out.append(s)
            yield pa.RecordBatch.from_pylist([{n: s[n] for n in names} for s in out], schema=pa.schema([*(batch.schema.field(n) for n in ("id", "question", "context")), ("grade", pa.string()), ("attempts", pa.int32()), ("steps", pa.list_(pa.string())), ("answer", pa.string()), ("done", pa.bool_())]))

    names = ["id", "question", "context", "grade", "attempts", "steps", "answer", "done"]
    for _ in range(most_attempts + 1):
        known = rows
        own = [F.array().cast(_CONTEXT)]
        if facts is not None:
            known = known.join(facts, "id", "left")
            own.append(F.coalesce(F.col("facts").cast(_CONTEXT), F.array().cast(_CONTEXT)))
        if "vectors" in tables:
            table = tables["vectors"]
            query = embed(rows.select("id", "question")).select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
            near = vectors.nearest_each(table.select("chunk_id", "vector"), query, hits, key="chunk_id", own=True)
            item = F.struct(F.coalesce("text_content", F.lit("")).alias("text"), "chunk_id", F.col("episode_chaos").cast("double").alias("chaos"))
            found = near.join(table.drop("vector"), "chunk_id").groupBy(F.col("query_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", item.alias("item")))), lambda x: x["item"]).alias("near"))
            known = known.join(found, "id", "left")
            own.append(F.coalesce(F.col("near").cast(_CONTEXT), F.array().cast(_CONTEXT)))
        state = shelf.put(known.select("id", "question", F.concat(*own).alias("context"), "attempts", "steps").mapInArrow(run, _STATE.format(kind)))
        ready.append(state.where("done"))
        rows = state.where("NOT done").select("id", "question", "attempts", "steps")
        if not rows.limit(1).count():
            break
    out = ready[0]
    for r in ready[1:]:
        out = out.union(r)
    return out.drop("done")
