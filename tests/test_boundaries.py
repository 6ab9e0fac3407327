import random
import re

from strandline.operators import boundaries
from strandline.plans import sizes


def corpus():
    """Abbreviations ``dr``, ``e.g``, ``approx``-like short ones that always carry a period, and words that end sentences now and then."""
    r = random.Random(3)
    words = ["river", "stone", "walked", "house", "green", "along", "every", "market", "silver", "window"]
    out = []
    for i in range(200):
        parts = []
        for _ in range(6):
            body = " ".join(r.choice(words) for _ in range(r.randrange(4, 9)))
            short = r.choice(["Dr. Stone", "e.g. silver", "St. Market", "vs. green"])
            parts.append(f"The {body} {short} {r.choice(words)}{r.choice(['.', '.', '.', '!', '?'])}")
        out.append((i, " ".join(parts)))
    return out


def cut(rows):
    return {r.doc_id: r.sentences for r in rows.collect()}


def test_abbreviations_are_found(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    found = {r.word: r for r in boundaries.abbreviations(docs).collect()}
    assert set(found) == {"dr", "e.g", "st", "vs"} and all(r.bare == 0 and r.score >= boundaries.LEAST for r in found.values())
    assert boundaries.abbreviations(docs.where("doc_id < 0")).count() == 0


TEXTS = {
    1: ("He met Dr. Stone at St. Market. She left.", ["He met Dr. Stone at St. Market. ", "She left."]),
    2: ("J. R. Smith came. \"Why?\" he asked. 'No!' They left", ["J. R. Smith came. ", "\"Why?\" ", "he asked. ", "'No!' ", "They left"]),
    3: ("On the 3. day it rained. In 1999. The end...  And more", ["On the 3. day it rained. ", "In 1999. ", "The end... ", " And more"]),
    4: ("Wait... what. (Really.) Yes", ["Wait... what. ", "(Really.) ", "Yes"]),
    5: ("", [""]),
    6: ("no end", ["no end"]),
    7: ("tabs.\tand\nlines.\nNew é.g. Ünï. Cödé 😀. Ok", ["tabs.\t", "and\nlines.\n", "New é.g. ", "Ünï. ", "Cödé 😀. ", "Ok"]),
    8: ("a \u0001\u001f\u0001 b. C", ["a \u0001\u001f\u0001 b. C"]),
}


def test_splits_and_offsets(spark, monkeypatch):
    docs = spark.createDataFrame([*((k, x) for k, (x, _) in TEXTS.items()), (9, None), *((100 + i, x) for i, x in corpus()[:30])], "doc_id long, text string")
    short = boundaries.abbreviations(spark.createDataFrame(corpus(), "doc_id long, text string"))
    one = cut(boundaries.with_sentences(docs, short))
    monkeypatch.setattr(sizes, "MOST_PHRASES", 1)
    two = cut(boundaries.with_sentences(docs, short))
    assert one == two and one[9] is None
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k, found in one.items():
        if found is not None:
            assert "".join(s.sentence for s in found) == texts[k] and [texts[k][s.start : s.end] for s in found] == [s.sentence for s in found]
    for k, (_, want) in TEXTS.items():
        assert [s.sentence for s in one[k]] == want, k
    for k, x in corpus()[:30]:  # planted: six sentences each, whatever the abbreviations
        assert len(one[100 + k]) == 6 == len(re.findall(r"The ", x))
