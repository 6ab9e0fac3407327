"""Runs of words by number, against plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from strandline.functions import text as t
from strandline.operators import clean, grams
from strandline.params import Params
from strandline.plans import sizes


def texts(spark, seed=3, n=60):
    r = random.Random(seed)
    rows = [(i, None if i % 17 == 5 else " ".join(r.choice("ab") for _ in range(r.choice([0, 1, 2, 3, 9, 40])))) for i in range(n)]
    return spark.createDataFrame(rows, "id int, raw_text string").repartition(3), [(i, (x or "").split()) for i, x in rows]


def test_phrases_are_counted_as_a_loop_counts_them(spark, monkeypatch):
    docs, plain = texts(spark)
    for words_at_once, n in ((grams.AT_ONCE, 3), (20, 3), (20, 1)):
        monkeypatch.setattr(grams, "AT_ONCE", words_at_once)
        want = {}
        for _, w in plain:
            for g in {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}:
                want[g] = want.get(g, 0) + 1
        got = clean.phrase_frequency(docs, Params(ngram=n, min_phrase_docs=12), key="id").collect()
        assert {r.gram: r.df for r in got} == {g: k for g, k in want.items() if k >= 12} and got


def test_no_text_is_built_for_rare_phrases(spark):
    """Only n-grams that pass the filter of frequent numbers reach the second count, however many are frequent."""
    docs = spark.range(300).select(F.col("id").cast("string").alias("episode_id"), F.concat(F.lit("one two three four five six "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("x"), i.cast("string"))), " ")).alias("raw_text"))
    words = docs.select(t.words(F.col("raw_text")).alias("words"))
    often = words.select(F.explode(grams.distinct_runs(grams.hashed(F.col("words")), 6)).alias("h")).groupBy("h").count().where("count >= 5").select("h")
    assert often.count() == 1
    bits = grams.bits_of(often, "h")
    assert int(np.unpackbits(bits).sum()) == 1
    built = words.select(F.size(grams.runs_that_may(F.col("words"), 6, docs, bits)).alias("n")).agg(F.sum("n")).first()[0]
    assert 300 <= built < 330


def test_the_filter_holds_every_number(spark):
    numbers = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5_000, dtype=np.int64)
    bits = grams.bits_of(spark.createDataFrame([(int(x),) for x in numbers], "h long"), "h")
    assert grams.maybe(bits, numbers.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 5_000, dtype=np.int64)
    assert grams.maybe(bits, others.view(np.uint64)).mean() < 0.05


def test_equal_first_numbers_are_told_apart():
    a, b = np.array([7, 7, 3, 7], np.uint64), np.array([1, 2, 5, 2], np.uint64)
    found = grams.Known(a, b).has(np.array([7, 7, 7, 3, 3, 9], np.uint64), np.array([2, 1, 3, 5, 1, 1], np.uint64))
    assert found.tolist() == [True, True, False, True, False, False]
    assert grams.Known(a[:0], b[:0]).has(a, b).tolist() == [False] * 4


def test_phrases_beyond_the_plan_need_no_shuffle(spark, monkeypatch):
    """More phrases than a plan takes are sent as numbers, so rows that repeat a key stay apart; beyond them a join gives the same rows."""
    docs, _ = texts(spark, n=40)
    toxic = spark.createDataFrame([("a b a",), ("b b b",), ("a  b",), ("a b",), (None,)], "gram string")
    p = Params(ngram=3, ad_min_chars=10, split=lambda x: F.split(x, "b a b"))
    monkeypatch.setattr(sizes, "MOST_PHRASES", 0)
    made = clean.silver(docs, toxic, p, key="id")
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    rows = sorted(map(tuple, made.collect()))
    rules = sorted(map(tuple, clean.sentence_rules(docs, toxic, p, key="id").collect()))
    assert any(r[3] == 3 for r in rules) and any(r[3] == 0 for r in rules)
    monkeypatch.setattr(sizes, "MOST_HASHED", 0)
    assert rows == sorted(map(tuple, clean.silver(docs, toxic, p, key="id").collect()))
    assert rules == sorted(map(tuple, clean.sentence_rules(docs, toxic, p, key="id").collect()))
    for r in rules:
        w = r[2].split()
        hit = len(r[2]) > 10 and any(" ".join(w[i : i + 3]) in ("a b a", "b b b") for i in range(len(w)))
        assert (r[3] == 3) == hit


def test_most_frequent_words_are_those_of_a_loop(spark, monkeypatch):
    docs, plain = texts(spark, seed=5)
    monkeypatch.setattr(grams, "AT_ONCE", 30)
    got = {r.id: [(-x.less, x.first, x.term) for x in r.x] for r in docs.select("id", grams.most_frequent(F.split("raw_text", " "), 2).alias("x")).collect()}
    texts_ = {r.id: r.raw_text for r in docs.collect()}
    for i, w in plain:
        w = [] if texts_[i] is None else texts_[i].split(" ")
        best = sorted({x: (-w.count(x), w.index(x)) for x in w}.items(), key=lambda x: x[1])[:2]
        assert got[i] == [(-n, at, x) for x, (n, at) in best]


def test_running_sums(spark):
    df = spark.createDataFrame([(0, [3, 0, 4]), (1, None), (2, []), (3, [5])], "id int, n array<int>").coalesce(1)
    assert dict(map(tuple, df.select("id", grams.running(F.col("n"))).collect())) == {0: [3, 3, 7], 1: None, 2: [], 3: [5]}


def test_chunks_are_counted_once_for_an_episode(spark):
    """A filter on the number of chunks would compute their bounds again."""
    from strandline.operators import graph

    gold = spark.createDataFrame([("a", "x. y", ["g"], ["c"], 1.0), ("b", "", ["g"], ["c"], 1.0), ("c", None, ["g"], ["c"], 1.0)], "episode_id string, content_body string, nlp_guests array<string>, top_concepts array<string>, chaos_score double")
    made = graph.episodes_of(gold, Params())
    assert "aggregate(" not in "".join(x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x)
    assert [(r.episode_id, r.n_chunks) for r in made.collect()] == [("a", 1)]


def test_sentence_ends_need_only_the_last_word(spark):
    """Odd ends of pieces, and a long word that a pattern from every place would read again and again."""
    from strandline.operators import boundaries

    rows = [("Dr. Who? yes! No.\" He (so.) said\r\n3. x 3. X a.b. Y  z. Q.  W... v",), ("x" * 20_000 + ". Then",), (None,), ("",)]
    split = boundaries.splitter(lambda w: w.isin("dr"))
    got = [r.s for r in spark.createDataFrame(rows, "text string").coalesce(1).select(split(F.col("text")).alias("s")).collect()]
    assert got[1:] == [["x" * 20_000 + ". ", "Then"], None, [""]] and "".join(got[0]) == rows[0][0]
    assert got[0][:3] == ["Dr. Who? ", "yes! ", 'No." ']
