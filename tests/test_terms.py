import math
import random
import re
from collections import Counter, defaultdict

from strandline.operators import terms

STOP = ("the", "with")


def grams(text):
    for i, s in enumerate(re.split(r"(?<=[.!?])\s+|\n", text or "")):
        w = re.findall(r"\w+", s.lower())
        for n in (2, 3, 4):
            for j in range(len(w) - n + 1):
                if all(len(x) >= 3 and x not in STOP for x in (w[j], w[j + n - 1])):
                    yield " ".join(w[j : j + n]), n, i, j


def corpus():
    r = random.Random(9)
    words = ["deep", "neural", "network", "training", "data", "set", "large", "of", "the", "with", "model"]
    out = []
    for i in range(80):
        parts = []
        for _ in range(3):
            body = [r.choice(words) for _ in range(8)]
            body[2:2] = r.choice([["deep", "neural", "network"], ["neural", "network"], ["training", "data"], ["large", "model", "of", "data"]])
            parts.append(" ".join(body).capitalize() + ".")
        out.append((i, " ".join(parts)))
    return [*out, (0, out[0][1]), (None, out[1][1]), (91, None), (92, ""), (93, "Deep neural. Network training")]


def test_against_plain_loops(spark):
    texts = corpus()
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    f, df, n, words = Counter(), Counter(), {}, Counter()
    for _, text in texts:
        own = Counter(g for g, *_ in grams(text))
        f.update(own)
        df.update(own.keys())
        words.update(re.findall(r"\w+", (text or "").lower()))
    good = {g for g in f if df[g] >= 3}
    n = {g: len(g.split()) for g in good}
    holders = defaultdict(set)
    for b in good:
        w = b.split()
        for m in range(2, n[b]):
            for j in range(n[b] - m + 1):
                if (a := " ".join(w[j : j + m])) in good:
                    holders[a].add(b)
    total, want = sum(words.values()), {}
    for g in good:
        held = holders[g]
        c = math.log2(n[g]) * (f[g] - (sum(f[b] for b in held) / len(held) if held else 0))
        pmi = math.log(f[g]) + (n[g] - 1) * math.log(total) - sum(math.log(words[w]) for w in g.split())
        want[g] = (n[g], f[g], df[g], len(held), round(c, 6), round(pmi / (-(n[g] - 1) * math.log(f[g] / total)), 6))
    table = terms.term_table(docs, stop=STOP)
    got = {r.term: (r.n, r.f, r.df, r.holders, round(r.cvalue, 6), round(r.association, 6)) for r in table.collect()}
    assert got == want and "neural network" in got and got["neural network"][3] > 0

    chosen = spark.createDataFrame([(g,) for g in good if want[g][4] > 10], "term string")
    kept = {r.term for r in chosen.collect()}
    rows = defaultdict(list)
    for r in terms.document_terms(docs, chosen, k=3, stop=STOP).orderBy("rank").collect():
        rows[r.doc_id].append((r.term, r["count"]))
    by = defaultdict(list)
    for k, text in texts:
        by[k] += [x for x in grams(text) if x[0] in kept]
    for k, own in by.items():
        count = Counter(x[0] for x in own)
        first = {g: min((i, j, -m) for h, m, i, j in own if h == g) for g in count}
        assert rows.get(k, []) == [(g, count[g]) for g in sorted(count, key=lambda g: (-count[g], first[g]))[:3]]
    assert terms.term_table(docs.where("doc_id < 0"), stop=STOP).count() == 0


def test_terms_are_counted_in_one_pass(spark, monkeypatch):
    """Each distinct term of a document is marked once, and the texts' candidates are computed once for the table."""
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(["b", "a", "b", "c", "b"],), ([],)], "x array<string>").select(terms._marked(F.array_sort("x")).alias("x")).collect()
    assert [[tuple(y) for y in r.x] for r in got] == [[("a", 1), ("b", 1), ("b", 0), ("b", 0), ("c", 1)], []]
    put, plans = terms.Shelf.put, []
    monkeypatch.setattr(terms.Shelf, "put", lambda self, df: plans.append(df._jdf.queryExecution().analyzed().toString()) or put(self, df))
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    assert terms.term_table(docs, stop=STOP).count() > 0
    assert sum("place" in x for x in plans) == 1


def test_documents_meet_their_terms_in_tasks(spark, monkeypatch):
    """Without a join up to a number of terms; beyond it, where candidates meet them in one, with the same rows."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    good = terms.Shelf(spark, "t").put(terms.term_table(docs, stop=STOP).where("cvalue > 10").select("term"))
    good = good.union(spark.createDataFrame([(None,), ("",), ("neural",), ("a  b",), ("Deep Network",)], "term string"))
    found = terms.document_terms(docs, good, k=3, stop=STOP)
    assert "Join" not in found._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(terms, "MOST_HASHED", 0)
    joined = terms.document_terms(docs, good, k=3, stop=STOP)
    assert "Join" in joined._jdf.queryExecution().analyzed().toString()
    assert sorted(map(repr, found.collect())) == sorted(map(repr, joined.collect())) != []


def test_only_frequent_candidates_become_text(spark):
    """The numbers have every candidate of enough documents, and hardly another; lines hold the words of the sentences."""
    from pyspark.sql import functions as F

    from strandline.functions import text as t

    odd = "ΑΣ. ΟΔΟΣ\u0001İx \t\nA_1.. B!?  c\r\n\n end.\u0085Σ ٣x 𝒳y. "
    docs = spark.createDataFrame([*corpus(), (94, odd), (95, odd + odd), (96, odd)], "doc_id long, text string").repartition(3)
    split = F.transform(t.sentences(F.coalesce("text", F.lit(""))), t.words)
    told = docs.select(terms.lines(F.col("text")).alias("words"), F.filter(split, lambda w: F.size(w) > 0).alias("want"))
    for r in told.collect():
        assert [x.split(" ") for x in r.words.split("\n") if x] == r.want and "  " not in r.words
    df = Counter(g for _, text in [*corpus(), *[(0, odd)] * 3] for g in {x[0] for x in grams(text)})
    numbers = {r.number for r in terms._often(told, "words", 3, STOP).collect()}
    often = spark.createDataFrame([(g,) for g in df if df[g] >= 3], "term string")
    made = [r.number & ((1 << 42) - 1) for r in terms._numbered(often).collect()]
    assert set(made) == numbers and len(made) == len(numbers) and len(numbers) < len(df)
