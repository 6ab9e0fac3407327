import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from strandline.llm import queries, sharding

from .odd import no_docs, odd_docs


def test_placing_follows_the_dot_product():
    items = np.random.default_rng(3).integers(1, 100, (400, 3)).astype(float)
    at = sharding.place(items, 7)
    for d in range(3):
        sums = np.bincount(at, items[:, d], 7)
        assert sums.max() / sums.mean() < 1.05
    assert sharding.place(np.zeros((0, 3)), 5).tolist() == []
    assert sorted(sharding.place(np.array([[2.0, 1, 1], [1, 2, 1]]), 2).tolist()) == [0, 1]


def test_items_go_where_the_dot_product_is_highest():
    """The greedy step against a plain loop, before items are moved."""
    r = np.random.default_rng(9)
    items = r.integers(1, 60, (150, 3)).astype(float)
    before, moved = sharding.level, []
    sharding.level = lambda at, share, shards: moved.append((at.copy(), share)) or at
    try:
        sharding.place(items, 6)
    finally:
        sharding.level = before
    at, share = moved[0]
    left, want = [[1.0] * 3 for _ in range(6)], {}
    for i in sorted(range(150), key=lambda i: (-max(share[i]), -sum(share[i]), i)):
        over = [max(max(x - y for x, y in zip(share[i], own)), 0) for own in left]
        dots = [sum(x * y for x, y in zip(share[i], own)) for own in left]
        fits = [s for s in range(6) if over[s] <= 1e-12]
        want[i] = max(fits, key=lambda s: (dots[s], -s)) if fits else min(range(6), key=lambda s: (over[s], -dots[s], s))
        left[want[i]] = [y - x for x, y in zip(share[i], left[want[i]])]
    assert [want[i] for i in range(150)] == at.tolist()


def test_moves_balance_all_dimensions():
    r = np.random.default_rng(1)
    items = np.exp(r.normal(0, 1.5, (6000, 3)))
    at = sharding.place(items, 24)
    for d in range(3):
        sums = np.bincount(at, items[:, d], 24)
        assert abs(sums / sums.mean() - 1).max() < 0.002


def holds(rows, texts, shards=24, kept=0.25):
    assert Counter(r.doc_id for r in rows) == Counter(k for k, _ in texts)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_query(spark):
    d = "/root/testdata/sf0.01"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    rows = queries.op9_shard(spark, d).collect()
    holds(rows, texts)
    body = dict(texts)
    groups, size, shard_of = defaultdict(list), Counter(), {}
    for r in rows:
        assert r.size == len(body[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(body[r.doc_id].encode())
        size[r.shard] += r.size
        shard_of[r.doc_id] = r.shard
        groups[body[r.doc_id]].append(r)
    words = {r.shard: 0 for r in rows}
    for r in rows:
        words[r.shard] += r.tokens
        assert r.tokens == len(re.findall(r"[^\x20\x09-\x0D]+", body[r.doc_id]))
    tokens, many = list(words.values()), list(Counter(r.shard for r in rows).values())
    assert max(tokens) < 1.02 * sum(tokens) / 24 and min(tokens) > 0.98 * sum(tokens) / 24
    assert max(many) < 1.05 * len(rows) / 24 and min(many) > 0.95 * len(rows) / 24
    mean = sum(size.values()) / 24
    assert max(size.values()) / mean < 1.01 and min(size.values()) / mean > 0.99
    whole = [g for g in groups.values() if sum(r.size for r in g) < mean / 4 and len(g) < len(rows) / 24 / 4]
    assert len(whole) > 800 and all(len({r.shard for r in g}) == 1 for g in whole)
    again = {r.doc_id: (r.shard, r.slot) for r in queries.op9_shard(spark, d).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in rows}


def test_odd_rows_and_a_hot_group(spark):
    docs = odd_docs(spark, ["the same text again"] * 300)
    rows = sharding.shard(docs).collect()
    holds(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert len({r.shard for r in rows if (r.doc_id or 0) >= 100}) > 12
    assert {r.text_crc32 for r in rows if r.doc_id == 2} == {0} and {r.size for r in rows if r.doc_id == 2} == {8}
    assert sharding.shard(no_docs(spark)).count() == 0


def test_thousands_of_equal_rows(spark):
    """Half of the table is one row again and again, a fifth has no id: sizes, tokens and counts stay near equal, reruns agree."""
    texts = [(i, f"text {i} " + "word " * (i % 50)) for i in range(2000)] + [(77, "the same row " * 10)] * 2000 + [(None, "without an id")] * 900
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    rows = sharding.shard(docs).collect()
    holds(rows, texts)
    for c in ("size", "tokens"):
        sums = Counter()
        for r in rows:
            sums[r.shard] += r[c]
        assert len(sums) == 24 and max(sums.values()) < 1.02 * sum(sums.values()) / 24 and min(sums.values()) > 0.98 * sum(sums.values()) / 24
    many = Counter(r.shard for r in rows).values()
    assert max(many) < 1.02 * len(rows) / 24 and min(many) > 0.98 * len(rows) / 24
    again = sharding.shard(docs.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, rows))


def test_items_of_a_group_are_equal_stretches(spark):
    """A row repeated without end, alone: each shard gets its share to the row."""
    docs = spark.createDataFrame([(1, "same")] * 2405, "doc_id long, text string")
    rows = sharding.shard(docs).collect()
    holds(rows, [(1, "same")] * 2405)
    many = Counter(r.shard for r in rows).values()
    assert max(many) - min(many) <= 4
