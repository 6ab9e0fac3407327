import random
import re
from collections import defaultdict

import numpy as np

from strandline.llm import near_dedup, queries
from strandline.llm.components import components
from strandline.llm.shelf import Shelf

from .odd import no_docs, odd_docs


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(texts):
    """Components by an inverted index over all rows: {row: (size, least id)}."""
    sets = [shingles(t) for _, t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in by[g]:
                shared[j] += 1
            by[g].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(texts):
        if k is not None:
            low[find(i)] = min(k, low.get(find(i), k))
    return [(k, len(sets[i]), low.get(find(i))) for i, (k, _) in enumerate(texts)]


def order(x):
    return tuple((v is None, v) for v in x)


def check(spark, texts, how=near_dedup.Banding()):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, how=how).collect()]
    assert sorted(got, key=order) == sorted(brute(texts), key=order)


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    rows = queries.op4_near_duplicates(spark, d).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == sorted(brute(texts))
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert sum(not r.kept for r in rows) > 50


def test_chains_and_shared_passages(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    texts, passage = [], [word() for _ in range(60)]
    base = [word() for _ in range(150)]
    for i in range(40):  # a chain: neighbours are similar, the ends are not
        base = list(base)
        base[(i * 7) % 150] = word()
        texts.append((1000 - i, " ".join(base)))
    for i in range(80):  # one passage in texts that are otherwise different
        own = [word() for _ in range(r.randrange(20, 120))]
        at = r.randrange(len(own))
        texts.append((2000 + i, " ".join(own[:at] + passage + own[at:])))
    for i in range(40):
        texts.append((3000 + i, " ".join(passage) + (" tail" * (i % 3))))
    check(spark, texts)


def test_threshold_is_inclusive(spark):
    a = [f"w{i}" for i in range(7)]  # 3 shingles, of which a text with one word more holds 3 of 4
    check(spark, [(1, " ".join(a)), (2, " ".join([*a, "end"])), (3, " ".join([*a, "end", "more"])), (4, "w0 w1"), (5, "W0  w1 "), (6, "w0 w2")])


def test_odd_rows(spark):
    docs = odd_docs(spark, ["One Two three four five six"] * 3)
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == 11
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert got[1] == (5, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True) and got[4] == (0, 4, True)
    assert got[None] == (1, None, True) and got[101] == (2, 100, False)
    assert near_dedup.near_duplicates(no_docs(spark)).count() == 0


def test_minhash_agreement_estimates_similarity():
    sets = np.sort(np.random.default_rng(1).integers(0, 2**63, 4000, dtype=np.uint64))
    a, b = sets[:3000], sets[1000:]
    sig = near_dedup.minhashes(np.concatenate([a, b]), np.array([3000, 3000]), 2000)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.05


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)], "a long, b long")
    got = {r.node: r.label for r in components(links, Shelf(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(101)}, 500: 500, 501: 500}


def test_components_with_more_links(spark):
    from strandline.llm.components import joined

    shelf = Shelf(spark, "test")
    pairs = lambda x: spark.createDataFrame(x, "a long, b long")
    labels = components(pairs([(1, 2), (3, 4), (8, 9)]), shelf)
    got = joined(labels, pairs([(2, 4), (9, 20), (30, 31), (1, 2)]), shelf)
    assert {r.node: r.label for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 20: 8, 30: 30, 31: 30}
    assert joined(labels, pairs([(2, 1)]), shelf).count() == 6


def test_shared_counts_equal_sets():
    r = np.random.default_rng(4)
    make = lambda n: [np.unique(r.integers(0, 5000, k).astype(np.uint64) ** 2 // np.uint64(4000)) for k in r.integers(0, 300, n)]
    left, right = make(90), make(70)
    assert near_dedup.shared_counts(left, right).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in right] for x in left]
    assert near_dedup.shared_counts([left[0][:0]], right).sum() == 0


def test_pairs_hidden_in_a_large_family(spark):
    """Thousands of texts at about 0.6 to 0.74 to each other; a few have a twin at 0.76 to 0.8 and no other link."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(7))
    base = [word() for _ in range(300)]

    def changed(text, n):
        text = list(text)
        for k in range(n):  # spread, so each change costs five shingles
            text[r.randrange(k * len(text) // n, (k + 1) * len(text) // n)] = word()
        return text

    texts = []
    for i in range(3000):
        own = changed(base, 7)
        texts.append((i, " ".join(own)))
        if i % 50 == 0:
            texts.append((10_000 + i, " ".join(changed(own, 7))))
    truth = brute_few(texts)
    assert sum(c != k for k, _, c in truth) > 50 and len({c for _, _, c in truth}) > 2000
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()]
    assert sorted(got) == sorted(truth)


def brute_few(texts):
    """As ``brute``, with the common shingles of a family counted as a matrix."""
    sets = [shingles(t) for _, t in texts]
    number = {}
    for s in sets:
        for g in s:
            number.setdefault(g, len(number))
    df = np.bincount([number[g] for s in sets for g in s])
    common = {int(g): i for i, g in enumerate(np.flatnonzero(df > 20))}
    dense, rare = np.zeros((len(sets), len(common)), np.float32), defaultdict(list)
    for i, s in enumerate(sets):
        for g in map(number.get, s):
            if g in common:
                dense[i, common[g]] = 1
            else:
                rare[g].append(i)
    both = np.rint(dense @ dense.T).astype(int)
    for rows in rare.values():
        both[np.ix_(rows, rows)] += 1
    sizes = np.array([len(s) for s in sets])
    label = np.array([k for k, _ in texts])
    x, y = np.nonzero(100 * both >= 75 * (sizes[:, None] + sizes[None, :] - both))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        if (new == label).all():
            return [(k, len(s), int(c)) for (k, _), s, c in zip(texts, sets, label)]
        label = new


def test_twins_outside_the_largest_component(spark):
    """Neither twin is in the component that holds most of a bucket of 200, and only they are similar."""
    how = near_dedup.Banding()
    texts = [(i, " ".join(f"w{i}x{k}" for k in range(30))) for i in range(199)]
    docs = spark.createDataFrame([*texts, (199, texts[198][1] + " end")], "doc_id long, text string")
    shelf = Shelf(spark, "test")
    classes = shelf.put(near_dedup.set_classes(shelf.put(near_dedup.profiles(docs, text="text", key="doc_id", how=how))))
    node = {r.id: r.node for r in classes.collect()}
    labels = spark.createDataFrame([(node[i], node[0]) for i in range(150)], "node long, label long")
    keys = spark.createDataFrame([(7, node[i], 26) for i in range(200)], "key long, node long, n long")
    family = near_dedup.families(near_dedup.mixed_buckets(keys, labels), shelf, how)
    assert family.count() == 200
    sets = near_dedup.full_sets(classes.select("node"), docs, classes, how, text="text", key="doc_id")
    links = near_dedup.family_links(family, labels, sets, how)
    assert {frozenset((r.a, r.b)) for r in links.collect()} == {frozenset((node[198], node[199]))}


def test_components_of_many_chunks(spark, monkeypatch):
    """Several levels: a task holds few links at a time."""
    from strandline.llm import components as module

    monkeypatch.setattr(module, "CHUNK", 7)
    r = random.Random(3)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    r.shuffle(pairs)
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    links = spark.createDataFrame(pairs, "a long, b long").repartition(9)
    assert {x.node: x.label for x in components(links, Shelf(spark, "test")).collect()} == {x: find(x) for x in list(parent)}


def test_equal_halves_of_a_digest_are_not_enough(spark):
    """Classes are told apart by both halves."""
    rows = spark.createDataFrame([(1, 5, 7, 1, b"x" * 224), (2, 5, 7, 2, b"x" * 224), (3, 5, 7, 1, b"x" * 224)], "id long, n long, d1 long, d2 long, sig binary")
    assert sorted(r.id for r in near_dedup.set_classes(rows).collect()) == [1, 2]


def test_many_rows_with_one_id_or_none(spark):
    """Sets meet classes by their digests: a thousand texts without an id, and hundreds with the same, are as much work as others."""
    r = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    base = [r.choice(words) for _ in range(60)]
    texts = []
    for i in range(1200):
        own = list(base)
        own[r.randrange(60)] = f"x{i}"
        texts.append((None if i < 900 else 7, " ".join(own)))
    texts += [(1000 + i, " ".join(r.choice(words) for _ in range(40))) for i in range(50)]
    check(spark, texts)
