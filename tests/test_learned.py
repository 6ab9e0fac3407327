import math
import random
from collections import Counter
from dataclasses import replace

import numpy as np

from strandline.operators import learned, vectors
from strandline.sources.shelf import Shelf

HOW = learned.Learning(share=0.01, least=2, size=6, more=40, window=2)


def corpus(n=300):
    """``big`` and ``large`` stand in the same places, ``blue`` and ``azure`` too; no two of a pair meet."""
    r = random.Random(4)
    out = []
    for i in range(n):
        size, tint = r.choice(["big", "large"]), r.choice(["blue", "azure"])
        parts = [f"the {size} dog barked at the {r.choice(['cat', 'fox', 'man'])}", f"a {tint} sky over the {r.choice(['sea', 'bay', 'lake'])}", f"{r.choice(['one', 'two'])} trains left the station"]
        r.shuffle(parts)
        out.append((i, " . ".join(parts)))
    return out


def brute(texts, how):
    """The matrix of mutual information in plain loops."""
    docs = [[w.lower() for w in t.replace(".", " ").split()] for _, t in texts]
    df = Counter(w for d in docs for w in set(d))
    words = sorted(w for w, n in df.items() if n >= max(how.least, how.share * len(docs)))
    n = Counter()
    for d in docs:
        for i, a in enumerate(d):
            for b in d[max(0, i - how.window) : i] + d[i + 1 : i + 1 + how.window]:
                if a in words and b in words:
                    n[a, b] += 1
    s, total = Counter(), sum(n.values())
    for (a, _), k in n.items():
        s[a] += k
    m = np.zeros((len(words), len(words)))
    for (a, b), k in n.items():
        m[words.index(a), words.index(b)] = max(0.0, math.log(k * total / (s[a] * s[b])))
    return words, m


def test_against_a_full_decomposition(spark):
    texts = corpus()
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    e = learned.fit(docs, HOW)
    words, m = brute(texts, HOW)
    assert e.words == words
    values, u = np.linalg.eigh(m)
    best = np.argsort(-abs(values))[: HOW.size]
    want = u[:, best] * np.sqrt(abs(values[best]))
    assert abs(e.vectors @ e.vectors.T - want @ want.T).max() < 1e-6


def test_planted_synonyms(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    e = learned.fit(docs, HOW)
    v = e.vectors / np.linalg.norm(e.vectors, axis=1, keepdims=True)
    near = lambda w: e.words[int(np.argsort(-(v @ v[e.words.index(w)]))[1])]
    assert near("big") == "large" and near("large") == "big" and near("blue") == "azure" and near("azure") == "blue"


def test_queries_and_chunks_alike_and_odd_rows(spark):
    docs = spark.createDataFrame([*corpus(), (None, None), (7, ""), (8, "unknown words only")], "doc_id long, text string")
    e = learned.fit(docs, HOW)
    path = f"{Shelf(spark, 'learned').root}/model"
    e.save(spark, path)
    again = learned.Embedding.load(spark, path)
    assert again.words == e.words and abs(again.vectors - e.vectors).max() == 0
    texts = spark.createDataFrame([("q", "a large dog", 1), ("c", "a large dog", 2), ("n", None, 3), ("e", "", 4), ("u", "zzz", 5), ("s", "the azure sky", 6)], "id string, text_content string, Vector int")
    got = {r.id: np.array(r.vector) for r in learned.embedded(texts, again).collect()}
    assert (got["q"] == got["c"]).all() and abs(np.linalg.norm(got["q"]) - 1) < 1e-6
    assert not got["n"].any() and not got["e"].any() and not got["u"].any() and got["q"] @ got["s"] < 0.9
    table = learned.embedded(docs, e, text="text").selectExpr("doc_id AS chunk_id", "vector").where("chunk_id IS NOT NULL")
    asked = table.where("chunk_id < 3").selectExpr("chunk_id AS query_id", "vector AS query")
    assert vectors.nearest_each(table, asked, 2, key="chunk_id").count() == 6


def test_bounds(spark):
    docs = spark.createDataFrame(corpus(40), "doc_id long, text string")
    try:
        learned.fit(docs, replace(HOW, most=3))
        raise AssertionError
    except ValueError as error:
        assert "larger share" in str(error)
    nothing = learned.fit(docs.where("doc_id < 0"), HOW)
    assert nothing.words == [] and not np.array(learned.embedded(docs.limit(1), nothing, text="text").first().vector).any()


def test_memory_of_a_task_is_bounded_by_words_at_once():
    """However many words a batch or a row has, a few words' vectors are held; the means are those of plain loops."""
    import tracemalloc

    import pyarrow as pa

    words = pa.array(["a", "b", "c"])
    e = learned.Embedding(["a", "b", "c"], np.arange(192.0).reshape(3, 64), np.array([1.0, 0.5, 0.25]), np.zeros(64))
    lists = pa.array([["a", "zz", "b"], None, [], ["c", "a"] * 150_000, ["zz"], ["b"]] + [["c", "b"]] * 60_000)
    tracemalloc.start()
    got = learned._means(lists, words, e)
    peak = tracemalloc.get_traced_memory()[1] - got.nbytes * 2
    tracemalloc.stop()
    assert peak < 60e6
    a, b, c = (e.vectors[i] * e.weights[i] for i in range(3))
    assert np.allclose(got[:6], [(a + b) / 2, a * 0, a * 0, (a + c) / 2, a * 0, b]) and np.allclose(got[6:], (b + c) / 2)
    parts = list(learned._slices(lists, 1000))
    assert sum(len(x) for _, x in parts) == len(lists) and all(len(x) == 1 or len(x.flatten()) <= 1000 for _, x in parts)
