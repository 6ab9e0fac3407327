from strandline.operators import sentiment


def test_spread_and_scores(spark):
    pairs = [("good", "fine", 2.0), ("fine", "nice", 1.0), ("fine", "grim", 1.0), ("bad", "grim", 3.0), ("far", "off", 1.0)]
    frame = spark.createDataFrame([(a, b, m) for x, y, m in pairs for a, b in ((x, y), (y, x))], "a string, b string, m double")
    seeds = spark.createDataFrame([("good", 1.0), ("bad", -1.0), ("bad", -0.5), (None, 1.0), ("x", None)], "word string, score double")
    one = {r.word: round(r.score, 9) for r in sentiment.induced(frame, seeds, rounds=1).collect()}
    assert one == {"good": 1.0, "bad": -0.75, "fine": 0.85, "grim": -0.6375}
    two = {r.word: round(r.score, 9) for r in sentiment.induced(frame, seeds, rounds=2).collect()}
    fine = 0.85 * (2 * 1.0 + 1 * -0.6375) / 3
    assert two == {"good": 1.0, "bad": -0.75, "fine": round(fine, 9), "grim": round(0.85 * (0.85 - 2.25) / 4, 9), "nice": round(0.85 * 0.85, 9)}
    lexicon = spark.createDataFrame([("good", 1.0), ("bad", -0.5)], "word string, score double")
    docs = [(1, "Good! bad"), (2, "not good, not a b c good"), (3, "very good and bad"), (4, "very very not BAD"), (5, None), (6, ""), (7, "none"), (None, "good"), (8, "a b c not good"), (1, "bad")]
    rows = sentiment.scored(spark.createDataFrame(docs, "doc_id long, text string"), lexicon, negations=["not"], intensifiers=["very"]).collect()
    got = {r.doc_id: (r.words, round(r.score, 9)) for r in rows}
    assert got == {1: (3, 0.0), 2: (2, 0.0), 3: (2, round((1.5 - 0.75) / 2, 9)), 4: (1, 0.75), 5: (0, 0.0), 6: (0, 0.0), 7: (0, 0.0), 8: (1, -1.0), None: (1, 1.0)}
