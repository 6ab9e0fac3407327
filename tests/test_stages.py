import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions import scoring, text
from strandline.functions.providers import ExtractiveChat, capitalised_names, hashed_embedding, messages, prompted, safe
from strandline.operators import chunk, clean, enrich, graph, ingest, report, vectors
from strandline.operators.agent import Agent, Api, State, planned
from strandline.params import Params

P = Params()


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_file_names(spark):
    cases = {
        "The Experience #12 - Ann Lee.txt": ("JRE-12", "JRE", "Ann Lee"),
        "The Experience #12 - Ann Lee (Part Two).txt": ("JRE-12-2", "JRE", "Ann Lee (Part Two)"),
        "The experience #7-Bo.txt": ("JRE-7", "JRE", "Bo"),
        "MMA Show #3 with Cy.txt": ("MMA-3", "MMA", "Cy"),
        "MMA Show #3 - with Cy (part 1).txt": ("MMA-3-1", "MMA", "Cy (part 1)"),
        "Best of 2020 (Part 1).txt": ("Special-Best_of_2020__Part_1_", "Special", "Unknown"),
    }
    got = spark.createDataFrame([(k,) for k in cases], "name string").select("name", ingest.file_metadata(F.col("name")).alias("m")).select("name", "m.*").collect()
    assert {r.name: tuple(r)[1:] for r in got} == cases


def test_ad_rules(spark):
    gram = "one two three four five six"
    long31, long30 = gram + "s" * 0 + " abc", gram + " ab"
    assert (len(long31), len(long30)) == (31, 30)
    lines = ["All day!", "All day long.", "Squarespace has a discount.", "I built it on Squarespace.", "Use the discount.", long31, long30]
    docs = spark.createDataFrame([("e", "\n".join(lines)), ("n", None), ("m", "")], "episode_id string, raw_text string")
    toxic = spark.createDataFrame([(gram,)], "gram string")
    got = {r.pos: r.rule for r in clean.sentence_rules(docs, toxic, P).collect()}
    assert got == {0: 1, 1: 0, 2: 2, 3: 0, 4: 0, 5: 3, 6: 0}
    out = {r.episode_id: r for r in clean.silver(docs, toxic, P).collect()}
    assert out["e"].content_body == f"All day long. I built it on Squarespace. Use the discount. {long30}" and out["e"].ads_removed_count == 3
    assert (out["n"].content_body, out["n"].ads_removed_count, out["n"].nlp_guests) == ("", 0, []) and out["m"].content_body == ""


def test_many_phrases_are_joined(spark, monkeypatch):
    """The rows are the same whether the phrases are part of the plan or meet the sentences in a join."""
    from strandline.plans import sizes

    line = "the quick brown fox jumps over {} lazy dogs today"
    docs = spark.createDataFrame([(i, f"{line.format('the' if i % 3 else 'some')}. Nothing else here.\u00a0 All day!", 1) for i in range(9)] + [(9, None, 1)], "id int, raw_text string, Pieces int")
    toxic = spark.createDataFrame([("quick brown fox jumps over the",)] * 2, "gram string")
    got = []
    for most in (20_000, 0):
        monkeypatch.setattr(sizes, "MOST_PHRASES", most)
        rules = sorted(map(tuple, clean.sentence_rules(docs, toxic, P, key="id").collect()))
        out = clean.silver(docs, toxic, P, key="id")
        assert out.columns == ["id", "Pieces", "content_body", "ads_removed_count", "nlp_guests"]
        got.append((rules, sorted(map(tuple, out.collect()))))
    assert got[0] == got[1]
    assert [r[1:] for r in got[0][0][:3]] == [(0, "the quick brown fox jumps over some lazy dogs today.", 0), (1, "Nothing else here.", 0), (2, "All day!", 1)]
    assert sum(r[3] == 3 for r in got[0][0]) == 6
    assert [r[3] for r in got[0][1]] == [1 + (i % 3 > 0) for i in range(9)] + [0]


def test_white_space_of_unicode(spark):
    assert values(spark, [("\u00a0\u2003x y\u3000\t",)], "a string", text.strip(F.col("a"))) == [("x y",)]
    assert values(spark, [("One.\u00a0Two!\u2009 Three",)], "a string", text.sentences(F.col("a"))) == [(["One.", "Two!", "Three"],)]


def test_phrase_safety_and_frequency(spark):
    phrases = ["i think we should all go", "i think you save a lot", "the best of all the things"]
    lex = P.lexicons
    got = values(spark, [(x,) for x in phrases], "x string", text.safe_phrase(F.col("x"), lex.keywords, lex.safe_starters))
    assert [g for (g,) in got] == [True, False, False]
    once = spark.createDataFrame([("a", "x y z u v w " * 9)], "episode_id string, raw_text string")
    assert {r.df for r in clean.phrase_frequency(once, Params(min_phrase_docs=1)).collect()} == {1}
    many = spark.createDataFrame([(str(i), "x y z u v w q") for i in range(7)], "episode_id string, raw_text string")
    assert clean.phrase_frequency(many, P).count() == 2 and clean.phrase_frequency(many, Params(mining_sample=4)).count() == 0
    assert clean.phrase_frequency(many, Params(mining_chars=11)).count() == 1


def sentence(n):
    return " ".join(["wordy"] * n) + "."


def test_features(spark):
    long = lambda *n: "\n".join(sentence(k) for k in n)
    visual = "Jamie pull that up. " + "Nothing else of interest is said in the rest of this text, which goes on for a while longer."
    rows = [("short", "x" * 99), ("null", None), ("few", "ab cd.\n" * 20), ("std", long(4, 9, 25, 7)), ("one", long(1, 2, 3, 10, 2, 2, 3, 3)), ("vis", visual), ("ten", long(*[20] * 10)), ("eleven", long(*[20] * 11)), ("late", long(*[1] * 5, *[20] * 11))]
    df = spark.createDataFrame(rows, "episode_id string, content_body string")
    got = {r.episode_id: r for r in enrich.gold(df, P).collect()}
    for k in ("short", "null", "few"):
        r = got[k]
        assert (r.chaos_score, r.complexity_score, r.sentiment, r.visual_event_count, r.business_start_index) == (0, 0, 0, 0, 0)
        assert r.top_concepts == []
    assert got["std"].chaos_score == 6.64 and got["one"].chaos_score == 0 and got["vis"].visual_event_count == 2
    assert got["ten"].business_start_index == 0 and got["eleven"].business_start_index == 0
    assert got["late"].business_start_index == sum(len(sentence(1)) + 1 for _ in range(5))


def test_top_concepts_break_ties_by_first_occurrence(spark):
    names = ["nine", "eight", "seven", "five5", "four", "three", "twotwo", "oneone", "zero"]
    df = spark.createDataFrame([("a", " ".join(names) + " " + "abc " * 40)], "episode_id string, content_body string")
    assert enrich.gold(df, P).first().top_concepts == names[:8]


def bounds(spark, lengths):
    df = spark.createDataFrame([(lengths,)], "n array<int>").withColumn("again", F.size("n"))
    return [(b.first, b.last) for b in df.select(chunk.chunk_bounds(F.col("n"), P).alias("b")).first().b]


def test_chunk_bounds(spark):
    cases = {(400, 400, 400, 10): [(1, 2), (3, 4)], (400, 400, 150, 400): [(1, 3), (3, 4)], (60, 990): [(1, 1), (1, 2)], (40, 1200): [(1, 2)], (1200,): [(1, 1)], (): []}
    assert {k: bounds(spark, list(k)) for k in cases} == cases


def packed(lengths):
    """A plain loop over the rule."""
    done, own, size = [], [], 0
    for i, n in enumerate(lengths, 1):
        if size + n > 1000 and size >= 50:
            done.append((own[0], own[-1]))
            keep, total = [], 0
            for j in reversed(own):
                if total + lengths[j - 1] > 200:
                    break
                keep.insert(0, j)
                total += lengths[j - 1]
            own, size = keep, total
        own.append(i)
        size += n
    return done + ([(own[0], own[-1])] if own else [])


@settings(max_examples=25, deadline=None)
@given(lists=st.lists(st.lists(st.integers(0, 1100) | st.integers(0, 90), max_size=30), min_size=1, max_size=12))
def test_chunk_bounds_equal_a_plain_loop(spark, lists):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, n array<int>")
    got = {r.i: [(b.first, b.last) for b in r.b] for r in df.select("i", chunk.chunk_bounds(F.col("n"), P).alias("b")).collect()}
    for i, x in enumerate(lists):
        assert got[i] == packed(x)
        assert {k for a, b in got[i] for k in range(a, b + 1)} == set(range(1, len(x) + 1))


def test_host_probability_and_ids(spark):
    lex = P.lexicons
    rows = ["hello", "really?", "jamie", "whoa", "whoa whoa", "jamie, look at that?"]
    got = values(spark, [(x,) for x in rows], "x string", F.round(scoring.host_probability(F.col("x"), lex.host_markers, lex.extra_marker), 9))
    assert [g for (g,) in got] == [0.0, 0.15, 0.65, 0.25, 0.25, 1.0]
    gold = spark.createDataFrame([("e", ("Some words here. " * 400), ["A"], ["x"], 1.0, 5)], "episode_id string, content_body string, nlp_guests array<string>, top_concepts array<string>, chaos_score double, business_start_index long")
    rows = chunk.chunks(gold, P).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows[:2]] == ["e-0000", "e-0001"] and [r.stage for r in rows[:3]] == ["Feedforward", "Feedforward", "Business"]
    assert spark.range(1).select(F.format_string("%s-%04d", F.lit("e"), F.lit(12345))).first()[0] == "e-12345"


CHUNKS = "chunk_id string, episode_id string, guest_list array<string>, top_concepts array<string>, episode_chaos double"


def built(spark, rows):
    own = spark.createDataFrame(rows, CHUNKS)
    eps = graph.episodes(own, P)
    valid = graph.valid_episodes(eps, P)
    return own, eps, valid, graph.edges(own, valid)


def test_graph_of_one_episode(spark):
    rows = [(f"e-{i:04d}", "e", ["A", " B "], ["x", "y", "z"], 15.01) for i in range(2)]
    _, eps, valid, edges = built(spark, rows + [("f-0000", "f", ["C"], None, 15.0), ("g-0000", "g", None, [], None)])
    kinds = {r.type: r["count"] for r in edges.groupBy("type").count().collect()}
    assert kinds == {"DISCUSSED": 12, "CO_OCCURRENCE": 6} and edges.where("chaos").count() == 18
    ids = {(r.id, r.type) for r in graph.nodes(eps, P).collect()}
    assert ids == {("A", "PERSON"), ("B", "PERSON"), ("C", "PERSON"), ("x", "CONCEPT"), ("y", "CONCEPT"), ("z", "CONCEPT")}
    up = graph.upserted(valid, graph.nodes(eps, P)).collect()
    assert len(up) == 9 and {r.chunk_id for r in up} == {"e-0001"} and {r.mentions for r in up} == {2}
    assert sorted((r.source, r.target) for r in up if r.type == "CO_OCCURRENCE") == [("x", "y"), ("x", "z"), ("y", "z")]
    _, eps, _, edges = built(spark, rows[:1])
    assert edges.count() == 0 and {r.type for r in graph.nodes(eps, P).collect()} == {"PERSON"}
    assert {r.episode_id: r.chaos for r in built(spark, [("a-0", "a", ["A"], ["x"], 15.0), ("FC-0", "FC-1", ["A"], ["x"], 0.0)])[1].collect()} == {"a": False, "FC-1": True}


def test_episodes_with_and_without_a_chunk_table(spark):
    rows = [("e", "Some words here. " * 300, ["A", "B"], 1.0, 0), ("f", "few words", ["A"], 20.0, 0), ("g", "", ["A"], 0.0, 0), ("h", None, None, 0.0, 0), ("i", "More. " * 400, ["C"], None, 0)]
    docs = spark.createDataFrame(rows, "episode_id string, content_body string, nlp_guests array<string>, chaos_score double, business_start_index long")
    lists = spark.createDataFrame([("e", ["x", "y"]), ("f", ["y"]), ("g", ["x"]), ("i", ["z", "x"])], "episode_id string, top_concepts array<string>")
    own = chunk.chunks(docs.join(lists, "episode_id", "left"), P)
    one, two = graph.episodes(own, P), graph.episodes_of(docs.join(lists, "episode_id", "left"), P)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and two.count() == 3
    a, b = graph.valid_episodes(one, P), graph.valid_episodes(two, P)
    assert sorted(map(tuple, graph.edges(own, a).collect())) == sorted(map(tuple, graph.edges_of(b).collect())) != []


def test_graph_queries(spark):
    pairs = [("A", "x"), ("B", "x"), ("B", "y"), ("C", "y"), ("C", "z"), ("D", "z")]
    edges = spark.createDataFrame([(a, b, "DISCUSSED", f"{a}{b}", a == "A", 1.0) for a, b in pairs] + [("x", "z", "CO_OCCURRENCE", "c", True, 0.5)], "source string, target string, type string, chunk_id string, chaos boolean, weight double")
    path = lambda a, b: graph.shortest_path(edges, a, b)
    assert path("A", "B") == ["A", "x", "B"] and path("A", "C") == ["A", "x", "B", "y", "C"] and path("C", "A") == ["C", "y", "B", "x", "A"]
    assert path("A", "D") is None and path("A", "nobody") is None and path("A", "A") == ["A"]
    assert [tuple(r) for r in graph.neighbours(edges, "X", 10).collect()] == [("x", "DISCUSSED", "A", "Ax"), ("x", "DISCUSSED", "B", "Bx")]
    assert [tuple(r) for r in graph.chaos_edges(edges, 1).collect()] == [("Ax", "A", "x")]
    a, b = spark.createDataFrame([("A", "PERSON")], "id string, type string"), spark.createDataFrame([("A", "PERSON"), ("A", "CONCEPT")], "id string, type string")
    assert graph.merged_nodes(a, b).count() == 2


def test_nearest_vectors(spark):
    own = spark.createDataFrame([("a", [1.0, 0.0], 0.1), ("b", [0.0, 2.0], 0.2), ("c", [0.0, 0.0], 0.3)], "chunk_id string, embedding array<float>, episode_chaos double")
    table = vectors.vector_table(own)
    assert table.columns[1] == "vector" and [r.chunk_id for r in vectors.nearest(table, [0.0, 1.0], 2).collect()] == ["b", "c"]
    with pytest.raises(ValueError):
        vectors.vector_table(spark.range(1).toDF("a"))
    q = spark.createDataFrame([("a", [1.0, 0.0])], "query_id string, query array<double>")
    assert [r.chunk_id for r in vectors.nearest_each(table, q, 1, key="chunk_id").collect()] == ["c"]
    texts = spark.createDataFrame([("t", "some words and more words"), ("u", "")], "chunk_id string, text_content string")
    rows = vectors.embedded(texts, hashed_embedding(16)).collect()
    assert abs(sum(x * x for x in rows[0].vector) - 1) < 1e-5 and set(rows[1].vector) == {0.0}


def test_nearest_in_blocks(spark):
    import numpy as np

    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=3).tolist()) for i in range(90)] + [(100 + i, [1.0, 0.0, 0.0]) for i in range(9)] + [(200, None), (201, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    asked = spark.createDataFrame(rows, "query_id long, query array<double>")
    want = []
    for q, v in rows:
        if v:
            near = sorted((sum((x - y) ** 2 for x, y in zip(v, w)), i) for i, w in rows if w and i != q and len(w) == len(v))[:3]
            want += [(q, n + 1, i, round(d, 9)) for n, (d, i) in enumerate(near)]
    for block in (1024, 10):
        got = vectors.nearest_each(table, asked, 3, block=block).collect()
        assert sorted((x.query_id, x["rank"], x.vec_id, round(x.distance, 9)) for x in got) == sorted(want)
    empty = table.where("vec_id < 0")
    assert vectors.nearest_each(empty, asked, 3).count() == 0 == vectors.nearest_each(table, empty.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")), 3).count()


def test_embedding_by_a_model_in_batches(spark):
    import numpy as np

    def encode(texts):
        assert 0 < len(texts) <= 4
        return np.array([[len(x), 3.0] for x in texts])

    chunks = spark.createDataFrame([(i, "x" * i if i else None) for i in range(11)], "chunk_id int, text_content string")
    got = {x.chunk_id: x.vector for x in vectors.embedded_in_batches(chunks, encode, batch=4).collect()}
    assert len(got) == 11 and got[0] == [0.0, 1.0] and abs(got[4][0] - 0.8) < 1e-6


def test_hashed_embedding_equals_a_plain_loop(spark):
    x = "some words and more words here are some"
    h = {r.w: r.h for r in spark.createDataFrame([(w,) for w in set(x.split())], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    want = [0.0] * 8
    for w in x.split():
        want[h[w] % 8] += 1 if (h[w] >> 32) % 2 == 0 else -1
    size = sum(v * v for v in want) ** 0.5
    assert [round(v, 5) for v in values(spark, [(x,)], "x string", hashed_embedding(8)(F.col("x")))[0][0]] == [round(v / size, 5) for v in want]


def test_supplied_sentences_lemmas_and_tokens(spark):
    docs = spark.createDataFrame([("e", "ran runs run | ran a b c | " + "runs ran run x " * 10)], "episode_id string, content_body string")
    lemma = lambda words: F.transform(words, lambda w: F.when(w.isin("ran", "runs"), "run").otherwise(w))
    by = Params(split=lambda x: F.split(x, "[|]"))
    plain, given = (enrich.features(docs, by, lemmas=k).first().complexity_score for k in (None, lemma))
    assert given < plain and enrich.sentence_stats(F.col("x"), by) is not None
    assert docs.select(enrich.sentence_stats(F.col("content_body"), by).alias("s")).first().s.n_sentences == 3
    assert report.token_estimate(docs, "content_body", count=F.length).first().tokens == len(docs.first().content_body)


def test_plans_by_known_names(spark):
    nodes = spark.createDataFrame([("Ann Lee", "PERSON"), ("Ann", "PERSON"), ("ships", "CONCEPT"), ("it", "CONCEPT")], "id string, type string")
    plan = lambda q: planned({"nodes": nodes}, q)
    assert plan("How are ann lee and ships connected?") == ("path", {"start": "Ann Lee", "end": "ships"})
    assert plan("Who knows about ships?") == ("authority", {"concept": "ships"})
    assert plan("Tell me of Ann Lee") == ("neighbours", {"entity": "Ann Lee"}) and plan("What is it?") == ("persons", {}) == planned({}, "x")
    assert plan("the most chaotic part") == ("chaos", {})
    edges = spark.createDataFrame([("Ann", "ships", "DISCUSSED", "e-0", True, 1.0), ("Bo", "ships", "DISCUSSED", "e-1", False, 1.0)], "source string, target string, type string, chunk_id string, chaos boolean, weight double")
    assert [tuple(r) for r in graph.path_rows(edges, "Ann", "Bo").collect()] == [(0, "Ann"), (1, "ships"), (2, "Bo")]


class Grader:
    def __init__(self, *grades):
        self.grades = list(grades)

    def __call__(self, task, question, context, history):
        if task == "grade":
            return self.grades.pop(0) if len(self.grades) > 1 else self.grades[0]
        return "new question" if task == "rewrite" else "answer to " + question


def test_agent_steps():
    something = lambda s: [{"text": "x", "chunk_id": "c", "chaos": 0}]
    run = lambda chat, found=something: Agent({}, lambda q: [], chat=chat, retrieve=found).run("q")
    assert run(Grader("YES")).steps == ["cypher_gen", "retrieval", "grade", "generate"]
    twice = run(Grader("no", "yes"))
    assert twice.steps == ["cypher_gen", "retrieval", "grade", "rewrite", "retrieval", "grade", "generate"] and twice.answer == "answer to new question"
    assert run(Grader("NO")).steps == ["cypher_gen", *["retrieval", "grade", "rewrite"] * 3, "retrieval", "grade", "generate"]
    assert run(None, lambda s: []).grade == "not_useful"


def test_agent_retrieves_from_both_sides(spark):
    edges = spark.createDataFrame([("Ann", "ships", "DISCUSSED", "e-0", True, 1.0)], "source string, target string, type string, chunk_id string, chaos boolean, weight double")
    table = spark.createDataFrame([("e-0", "ships at sea", 0.5, [1.0, 0.0])], "chunk_id string, text_content string, episode_chaos double, vector array<float>")
    agent = Agent({"edges": edges, "vectors": table}, lambda q: [1.0, 0.0], plan=lambda q: ("neighbours", {"entity": "ann"}))
    api = Api(agent, edges)
    got = api.chat("Who talks about ships?")
    assert got["sources"] == ["GRAPH", "e-0"] and got["response"] == "Graph Fact: entity: Ann | rel: DISCUSSED | connected_to: ships | chunk: e-0"
    assert api.search_graph("ANN")["results"] == [{"entity": "Ann", "rel": "DISCUSSED", "connected_to": "ships", "chunk": "e-0"}]
    broken = Agent({"edges": edges}, lambda q: [1.0], plan=lambda q: ("no such template", {}))
    assert broken._retrieve(State("q", ("neighbours", {"entity": "ann"})))[0]["chunk_id"] == "GRAPH"
    for call in (lambda: Api(None, None).chat("x"), lambda: Api(None, None).search_graph("x")):
        with pytest.raises(ConnectionError):
            call()
    assert api.status() == {"status": "online"}


def test_reports(spark):
    def ask(q):
        if q == "bad":
            raise OSError
        return {"response": "a\nb" * 60, "sources": ["x", "y"], "steps_taken": ["rewrite"] if q == "r" else []}

    out = report.run_benchmark(spark, [("c", "q"), ("c", "bad"), ("c", "r")], ask)
    rows = out.collect()
    assert [r.ID for r in rows] == [1, 3] and [r["Self-Corrected"] for r in rows] == [False, True] and rows[0]["Answer Preview"] == ("a b" * 60)[:100] + "..."
    assert report.benchmark_summary(out).first().correction_rate == 50
    talk = spark.createDataFrame([(1, i, "user", "t") for i in range(6)], "conv_id long, turn long, role string, text string")
    assert sorted(r.turn for r in report.last_turns(talk).collect()) == [2, 3, 4, 5]
    traces = spark.sql("SELECT 'q' question, null answer, timestamp'2024-01-01 00:00:00' start_time, timestamp'2024-01-01 00:00:02.346' end_time, 'success' status UNION ALL SELECT null, 'a', timestamp'2024-01-01', null, 'error'")
    assert sorted(tuple(r) for r in report.trace_report(traces).collect()) == [("N/A", "a", 0.0, "error"), ("q", "N/A", 2.35, "success")]


def test_providers(spark):
    names = capitalised_names(("blocked name",), 5)
    got = values(spark, [("Ann Lee met Blocked Name and Ann Lee and Élan Vital.",)], "x string", names(F.col("x")))
    assert got == [(["Ann Lee", "Élan Vital"],)]
    assert safe(lambda: 1 / 0).startswith("[model error")
    chat = ExtractiveChat()
    assert chat("rewrite", "the big thing", [], []) == "thing" and chat("answer", "q", [{"text": "t"}], []) == "t"
    assert chat("grade", "which ships", [{"text": "Ships at sea"}], []) == "YES" and chat("grade", "which cars", [{"text": "Ships at sea"}], []) == "NO"
    sent = []
    asked = prompted(lambda m: sent.append(m) or "yes", "persona")
    assert asked("grade", "q", [{"text": "x" * 900}], [{"role": "user", "content": "h"}]) == "yes" and len(sent[0]) == 2 and len(sent[0][1]["content"]) < 540
    asked("answer", "q", [{"text": "x"}], [{"role": "user", "content": "h"}])
    assert [m["role"] for m in sent[1]] == ["system", "user", "user"] and "persona" in sent[1][0]["content"]
    m = messages("q", [{"chunk_id": "c", "text": "t"}, {"text_content": "u"}], [{"role": "user", "content": str(i)} for i in range(6)], "persona")
    assert len(m) == 6 and "- [c]: t\n- [Unknown]: u\n" in m[0]["content"] and m[1]["content"] == "2"
    assert len(messages("q", [], [{"role": "user", "content": "x"}], "persona", "task")) == 2


def test_text_primitives(spark):
    one = lambda x, *c: values(spark, [(x,)], "x string", *c)[0]
    x = F.col("x")
    assert one("Café 2² déjà_vu!", text.words(x)) == (["café", "2²", "déjà_vu"],)
    assert one("\u2003a b\n", text.strip(x))[0].strip() == "a b" and one("a.b. c!d? e\nf", text.sentences(x)) == (["a.b.", "c!d?", "e", "f"],)
    assert one("aaaa", text.occurrences(x, "aa")) == (2,) and one("```cypher\nMATCH```", text.without_fences(x)) == ("MATCH",)
    assert one("a b", text.ngrams(text.words(x), 6)) == ([],) and one("", text.words(x)) == ([],)
    assert json.loads(one("é", F.to_json(F.struct(x)))[0]) == {"x": "é"}
