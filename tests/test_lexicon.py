import random


from strandline.operators import lexicon


def plain(texts, phrases):
    return sorted((k, p, t.count(p)) for k, t in texts for p in {x for x in phrases if x} if t and p in t)


def test_against_plain_counts(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcé ") for _ in range(r.randrange(1, 6)))
    phrases = [word() for _ in range(300)] + ["aa", "aaa", "a", "", None, "ab" * 20, "aa"]
    texts = [(i, "".join(word() for _ in range(r.randrange(40)))) for i in range(60)] + [(90, None), (91, ""), (92, "aaaaaaa"), (92, "aaaaaaa"), (None, "ab")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    frame = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    order = lambda x: sorted(x, key=repr)
    want = [(k, p, n) for k, t in texts for k2, p, n in plain([(k, t)], phrases)]
    for most in (10_000_000, 200):  # one automaton, and many
        assert order(map(tuple, lexicon.hits(docs, frame, most=most).collect())) == order(want)
    some = spark.createDataFrame([("bca",), ("aaaa",)], "phrase string")
    assert order(r.text for r in lexicon.with_any(docs, some).collect()) == order(t for _, t in texts if t and ("bca" in t or "aaaa" in t))
    assert {r.doc_id: r.hits for r in lexicon.occurrences(docs, some).collect()}[92] == 2
    none = spark.createDataFrame([], "phrase string")
    assert lexicon.hits(docs, none).count() == 0 and lexicon.hits(docs.where("doc_id = -1"), frame).count() == 0


def test_a_hundred_thousand_phrases(spark):
    """No chain in the plan; the same rows as a search of each phrase."""
    r = random.Random(2)
    phrases = list({f"{r.choice('bcdfgh')}{r.choice('aeiou')}{i:x}" for i in range(100_000)})
    texts = [(i, " ".join(r.choice(phrases) if r.random() < 0.3 else "filler" for _ in range(200))) for i in range(12)]
    docs, frame = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string")
    found = lexicon.hits(docs, frame, most=400_000)
    assert found._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") == 0
    assert sorted(map(tuple, found.collect())) == plain(texts, phrases)
