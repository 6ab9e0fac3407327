import random
import re
from collections import Counter, defaultdict

from strandline.operators import lemmas


def corpus():
    r = random.Random(2)
    stems = ["walk", "jump", "paint", "climb", "laugh", "clean", "point", "sail"]
    forms = [s + e for s in stems for e in ("", "ed", "ing", "s")] + ["stone", "redder", "king", "thing", "bread", "été", "x1ed"]
    return [(i, " ".join(r.choice(forms) for _ in range(30))) for i in range(60)] + [(90, None), (91, ""), (92, "walked walks walk Walking! 12 x1ed")]


def brute(texts, least, support):
    words = [set(w for w in re.findall(r"\w+", (t or "").lower()) if w.isalpha()) for _, t in texts]
    df = Counter(w for own in words for w in own)
    by = defaultdict(list)
    for w in (w for w, n in df.items() if n >= least):
        for i in range(max(4, len(w) - 4), len(w) + 1):
            by[w[:i]].append((w, w[i:]))
    met = [(a, x, b, y) for own in by.values() for a, x in own for b, y in own if len(x) > len(y)]
    n = Counter((x, y) for _, x, _, y in met)
    best = {}
    for a, x, b, y in met:
        if n[x, y] >= support:
            best[a] = min(best.get(a, (0, 0, "")), (-n[x, y], len(b), b)) if a in best else (-n[x, y], len(b), b)
    return {w: (b[2], -b[0]) for w, b in best.items()}


def test_against_plain_loops(spark):
    texts = corpus()
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    table = lemmas.lemma_table(docs, support=5)
    got = {r.word: (r.lemma, r.support) for r in table.collect()}
    assert got == brute(texts, 3, 5)
    assert {w: got[w][0] for w in ("walked", "climbing", "sails")} == {"walked": "walk", "climbing": "climb", "sails": "sail"}
    assert not {"stone", "king", "bread", "walk"} & got.keys()
    counts = {r.doc_id: r.lemmas for r in lemmas.distinct_lemmas(docs, table).collect()}
    assert counts[92] == 1 and 90 not in counts and 91 not in counts
    assert lemmas.lemma_table(docs.where("doc_id < 0")).count() == 0
