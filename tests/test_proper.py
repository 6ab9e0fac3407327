import random
import re
from collections import Counter

from strandline.operators import proper
from strandline.plans import sizes


def corpus():
    r = random.Random(6)
    names = ["Ada", "Lovelace", "Alan", "Turing", "Marie", "O'Brien", "Éva", "Zoë"]
    small = ["the", "river", "was", "walked", "along", "stone", "will", "may"]
    out = []
    for i in range(150):
        parts = []
        for _ in range(4):
            body = [r.choice(small) for _ in range(6)]
            body[3:3] = r.sample(names, r.randrange(1, 4))
            parts.append(" ".join([body[0].capitalize(), *body[1:]]) + ".")
        out.append((i, " ".join(parts)))
    return out + [(900, "May we go. May they. we MAY stay"), (901, None), (902, "")]


def plain(texts, words, known=()):
    out = {}
    for k, text in texts:
        if text is None:
            out[k] = None
            continue
        found = []
        for run in re.findall(r"[A-ZÉÜ][\w'-]*(?: [A-ZÉÜ][\w'-]*)*", text):
            own, i, open_ = run.split(" "), 0, []
            while i < len(own):
                n = next((n for n in (4, 3, 2, 1) if i + n <= len(own) and " ".join(own[i : i + n]).lower() in known), 0)
                if n or own[i].lower() not in words:
                    found += [" ".join(open_)] if open_ else []
                    open_ = []
                    if n:
                        found.append(" ".join(own[i : i + n]))
                        i += n - 1
                else:
                    open_.append(own[i])
                    if len(open_) == 4:
                        found.append(" ".join(open_))
                        open_ = []
                i += 1
            found += [" ".join(open_)] if open_ else []
        out[k] = list(dict.fromkeys(found))
    return out


def test_case_counts_and_name_words(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    capital, small = Counter(), Counter()
    for _, text in corpus():
        for s in re.split(r"(?<=[.!?])\s+|\n", text or ""):
            for i, w in enumerate(re.findall(r"[^\W\d_][^\W\d_'-]*(?:['-][^\W\d_]*)*", s)):
                if w[0].isupper():
                    capital[w.lower()] += i > 0
                else:
                    small[w.lower()] += 1
    counts = proper.case_counts(docs)
    assert {r.word: (r.capital, r.small) for r in counts.collect()} == {w: (capital[w], small[w]) for w in capital | small}
    assert {r.word for r in proper.name_words(counts).collect()} == {"ada", "lovelace", "alan", "turing", "marie", "o'brien", "éva", "zoë"}


def test_names(spark, monkeypatch):
    texts = [*corpus()[:40], *corpus()[-3:], (1000, "Ada Lovelace Alan Turing Marie Zoë met New York City and The Ada. The River"), (1001, "New York and York New York City Ada")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    words = proper.name_words(proper.case_counts(spark.createDataFrame(corpus(), "doc_id long, text string")))
    known = spark.createDataFrame([("New York",), ("new york CITY",), (None,)], "name string")
    listed = {r.word for r in words.collect()}
    for most in (sizes.MOST_PHRASES, 1):  # a set in the plan, and a join
        monkeypatch.setattr(sizes, "MOST_PHRASES", most)
        assert {r.doc_id: r.names for r in proper.with_names(docs, words).collect()} == plain(texts, listed)
        got = {r.doc_id: r.names for r in proper.with_names(docs, words, known=known).collect()}
        assert got == plain(texts, listed, {"new york", "new york city"})
    assert got[1000] == ["Ada Lovelace Alan Turing", "Marie Zoë", "New York City", "Ada"] and got[1001] == ["New York", "New York City", "Ada"]
    assert got[900] == [] and got[901] is None
    two = proper.with_names(docs, words, most=2).collect()
    assert max(len(r.names or []) for r in two) == 2
