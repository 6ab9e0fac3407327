import math

import numpy as np
import pytest

from strandline.llm import multiprobe, queries, threshold_topk

SCHEMA = "vec_id long, embedding array<float>, rank int, ids int"


def brute(rows, every, k, score, ok=lambda v: True):
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and ok(v)}
    out = []
    for q in sorted({i for i, _ in rows if i % every == 0}):
        best = {}
        for own in (v for i, v in rows if i == q):
            for i, v in rows:
                if i != q and len(v) == len(own):
                    best[i] = max(best.get(i, -1e9), score(own, v))
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return out


def product(a, b):
    return sum(math.floor(1024 * x) * math.floor(1024 * y) for x, y in zip(a, b))


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))


def odd(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=6).astype(np.float32).tolist()) for i in range(-100, 300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # a very common vector
    rows += [(100, None), (400, []), (500, [math.nan] * 6), (600, [math.inf] * 6), (700, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (800, [0.0] * 6), (None, [1.0] * 6), (900, [1.0, 2.0]), (901, [2.0, 1.0])]
    rows += rows[100:102] + [(0, [0.5] * 6), (50, rows[3][1])]
    return rows, spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("block", [4096, 37])
def test_top_products_with_odd_rows(spark, block):
    rows, df = odd(spark)
    got = [tuple(r) for r in threshold_topk.top_products(df, block=block, chunk=3 if block == 37 else 4096).collect()]
    assert sorted(got) == brute(rows, 100, 10, product)


@pytest.mark.parametrize("block", [4096, 37])
def test_neighbours_with_odd_rows(spark, block):
    rows, df = odd(spark)
    got = sorted(tuple(r) for r in multiprobe.neighbours(df, block=block).collect())
    want = brute(rows, 50, 5, cosine, lambda v: any(v))
    assert [x[:2] for x in got] == [x[:2] for x in want]
    scores = {(q, i): s for q, _, i, s in brute(rows, 50, 10_000, cosine, lambda v: any(v))}
    assert all(abs(scores[q, i] - s) < 1e-9 for q, _, i, s in got)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert threshold_topk.top_products(df).count() == 0 and multiprobe.neighbours(df).count() == 0
    one = spark.createDataFrame([(0, [1.0, 0.0], 1, 1)], SCHEMA)
    assert threshold_topk.top_products(one).count() == 0 and multiprobe.neighbours(one).count() == 0


def test_queries_against_brute_force(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    whole = np.floor(1024 * x)
    want = []
    for q in np.flatnonzero(ids % 100 == 0):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:10]
        want += [(ids[q], n + 1, ids[i], int(s[i])) for n, i in enumerate(order)]
    assert sorted(tuple(r) for r in queries.op2_threshold_topk(spark, d).collect()) == sorted(want)
    got = queries.op5_multiprobe_ann(spark, d).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = unit @ unit[q]
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == ids[q])
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5] and all(abs(s[np.flatnonzero(ids == i)[0]] - c) < 1e-9 for _, i, c in own)
        best = [ids[i] for i in np.argsort(-s) if i != q][:5]
        hit, total = hit + len({i for _, i, _ in own} & set(best)), total + 5
    assert hit / total >= 0.9


def test_threshold_stops_early():
    r = np.random.default_rng(1)
    matrix = np.floor(1024 * r.normal(size=(5000, 3)))
    q = np.array([900.0, -20.0, 0.0])
    visited = threshold_topk.lists(matrix)(q[None], 11)[0]
    assert len(visited) < 2500 and set(np.argsort(-(matrix @ q))[:11]) <= set(visited)


def test_probe_sequence_rises():
    s = multiprobe.probe_sequence(4, 40)
    m, cost = 4, lambda j: (j + 1) * (j + 2) / 120 if j < 4 else 1 - (4 - (j - 4)) / 5 + (4 - (j - 4)) * (5 - (j - 4)) / 120
    sums = [sum(cost(j) for j in x) for x in s]
    assert s[0] == () and sums == sorted(sums) and len(set(s)) == 40 and all(2 * m - 1 - j not in x for x in s for j in x)


@pytest.mark.parametrize("block", [4096, 23])
def test_ids_with_many_vectors(spark, block):
    """Most ids stand with several vectors; the best k distinct ids are found all the same."""
    r = np.random.default_rng(6)
    rows = [(int(i), r.normal(size=4).astype(np.float32).tolist()) for i in r.integers(0, 60, 300)] + [(7, r.normal(1, 0.1, 4).astype(np.float32).tolist()) for _ in range(80)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)
    assert sorted(tuple(x) for x in threshold_topk.top_products(df, every=20, k=6, block=block).collect()) == brute(rows, 20, 6, product)
