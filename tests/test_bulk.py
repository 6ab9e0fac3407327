from pyspark.sql import functions as F

from strandline.functions import scoring as s
from strandline.functions.providers import hashed_embedding
from strandline.operators import bulk, graph, vectors
from strandline.operators.agent import Agent, planned

EDGE = "source string, target string, type string, chunk_id string, chaos boolean, mentions long, weight double"
QUESTIONS = [
    "Who is the expert on gravity?", "How are Ann Lee and Bob connected?", "The most chaotic talk", "What did ann lee say", "zzz qqq",
    "of to in", "", "Which path lies between Bob and Dan?", "tell me about quantum gravity",
]


def tables(spark):
    rows = [("Ann Lee", "gravity", 3), ("Bob", "gravity", 5), ("Bob", "quantum gravity", 1), ("Cid", "quantum gravity", 2), ("Cid", "music", 9), ("Dan", "music", 1)]
    edges = spark.createDataFrame([(a, b, "DISCUSSED", f"e-{i:04d}", i % 2 == 1, n, float(n)) for i, (a, b, n) in enumerate(rows)] + [("gravity", "music", "CO_OCCURRENCE", "e-0009", True, 1, 0.5)], EDGE)
    nodes = spark.createDataFrame([("PERSON", x) for x in ("Ann Lee", "Bob", "Cid", "Dan")] + [("CONCEPT", x) for x in ("gravity", "quantum gravity", "music", "of")], "type string, id string")
    chunks = spark.createDataFrame([(f"c{i}", x, float(i)) for i, x in enumerate(["gravity bends light", "music of the spheres", "an expert talk", None])], "chunk_id string, text_content string, episode_chaos double")
    return {"edges": edges, "upserted": edges, "nodes": nodes, "vectors": vectors.embedded(chunks)}


def embed_one(spark):
    def of(question):
        row = spark.createDataFrame([(question,)], "q string").select(s.normalised(hashed_embedding()(F.col("q"))).alias("v")).first()
        return [float(x) for x in row.v]

    return of


def test_same_as_one_by_one(spark):
    own = {k: v.cache() for k, v in tables(spark).items()}
    agent = Agent(own, embed_one(spark), most_attempts=1)
    asked = spark.createDataFrame(list(enumerate(QUESTIONS)), "id long, question string")
    got = {r.id: r for r in bulk.answered(own, asked, lambda df: vectors.embedded(df, text="question"), most_attempts=1).collect()}
    plans = {r.id: r for r in bulk.planned_each(asked, own["nodes"]).collect()}
    assert len(got) == len(QUESTIONS)
    for i, q in enumerate(QUESTIONS):
        name, how = planned(own, q)
        assert plans[i].template == name and [x for x in (plans[i].a, plans[i].b) if x is not None] == list(how.values()), q
        want = agent.run(q)
        assert got[i].steps == want.steps and got[i].answer == want.answer and got[i].question == want.question, q
        assert [c.asDict() for c in got[i].context] == want.context and (got[i].grade, got[i].attempts) == (want.grade, want.attempts)
    assert {p.template for p in plans.values()} == {"authority", "path", "chaos", "neighbours", "persons"}
    assert len({len(r.steps) for r in got.values()}) > 1


def test_paths_of_many_pairs(spark):
    edges = tables(spark)["edges"]
    names = ["Ann Lee", "Bob", "Cid", "Dan", "gravity", "nobody"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    for hops in (3, 6):
        got = {(r.a, r.b): r.path for r in bulk.paths_each(edges, pairs, hops).collect()}
        for a, b in (("Ann Lee", "Bob"), ("Ann Lee", "Dan"), ("Dan", "gravity"), ("Bob", "Bob"), ("Bob", "nobody"), ("nobody", "nobody")):
            assert got.get((a, b)) == graph.shortest_path(edges, a, b, hops), (a, b, hops)


def test_without_tables_and_with_a_failing_model(spark):
    asked = spark.createDataFrame([("a", "why"), ("b", None)], "id string, question string")

    def broken(task, question, context, history):
        raise RuntimeError("no model")

    rows = bulk.answered({}, asked, lambda df: df, chat=broken, most_attempts=2).collect()
    assert len(rows) == 2 and all(r.answer == "[model error: no model]" and r.attempts == 2 and r.steps.count("rewrite") == 2 for r in rows)
    assert bulk.answered({}, asked.where("id = 'z'"), lambda df: df).count() == 0
