import glob
import os
import random
from collections import defaultdict

import pytest

from strandline.operators import graph
from strandline.operators.store import GraphStore, NameIndex
from strandline.sources.shelf import Shelf, exists

EDGE = "source string, target string, type string, chunk_id string, chaos boolean, mentions long, weight double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def batch(spark, edges, nodes):
    return {"edges": spark.createDataFrame(edges, EDGE), "nodes": spark.createDataFrame(nodes, "type string, id string")}


def some(seed, n=60):
    r = random.Random(seed)
    edges = []
    for _ in range(n):
        kind = r.choice(["DISCUSSED", "CO_OCCURRENCE"])
        source = f"p{r.randrange(9)}" if kind == "DISCUSSED" else f"c{r.randrange(9)}"
        edges.append((source, f"c{r.randrange(9)}", kind, f"e{r.randrange(5)}-{r.randrange(12):04d}", r.random() < 0.5, r.randrange(1, 5), r.randrange(8) / 2))
    return edges, [("PERSON", f"p{i}") for i in range(seed % 3, 8)] + [("CONCEPT", f"c{i}") for i in range(9 - seed % 3)] * 2


def brute(*batches):
    nodes = {n for _, own in batches for n in own}
    by = defaultdict(list)
    for edges, _ in batches:
        for e in edges:
            by[e[:3]].append(e)
    out = []
    for (s, t, kind), own in by.items():
        if ("PERSON" if kind == "DISCUSSED" else "CONCEPT", s) in nodes and ("CONCEPT", t) in nodes:
            out.append((s, t, kind, *max((e[3], e[4]) for e in own), sum(e[5] for e in own), sum(e[6] for e in own)))
    return sorted(out, key=repr), sorted(nodes, key=repr)


@pytest.fixture
def root(spark):
    return Shelf(spark, "store").root


def test_batches_in_any_order_and_again(spark, root):
    one, two, three = some(1), some(2), some(3)
    a, b = GraphStore(spark, f"{root}/a", 5), GraphStore(spark, f"{root}/b", 3)
    new = [a.merge(name, **batch(spark, *own)) for name, own in (("1", one), ("2", two), ("1", one), ("3", three), ("3", three))]
    assert new == [True, True, False, True, False]
    for name, own in (("3", three), ("2", two), ("1", one)):
        assert b.merge(name, **batch(spark, *own))
    want, nodes = brute(one, two, three)
    for store in (a, b):
        assert rows(store.edges()) == want and rows(store.nodes()) == nodes and store.batches() == ["1", "2", "3"]
    assert GraphStore(spark, f"{root}/a", 99).buckets == 5
    assert rows(GraphStore(spark, f"{root}/a").edges()) == want


def files(root, table):
    root = root.removeprefix("file:")
    while root.startswith("//"):
        root = root[1:]
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{root}/{table}/bucket=*/*.parquet")}


def test_untouched_buckets_keep_their_files(spark, root):
    store = GraphStore(spark, root, 16)
    store.merge("all", **batch(spark, *some(1, 400)))
    before = files(root, "edges"), files(root, "nodes")
    store.merge("one", **batch(spark, [("p3", "c3", "DISCUSSED", "z-0001", True, 1, 1.0)], []))
    after = files(root, "edges"), files(root, "nodes")
    assert before[1] == after[1] and len(before[0]) > 8
    changed = {os.path.dirname(p) for p, _ in set(before[0].items()) ^ set(after[0].items())}
    assert len(changed) == 1


def test_a_merge_that_was_cut_off(spark, root, monkeypatch):
    """Between the writing of the new buckets and their last place: the next merge finishes it; before that: it is as if it had not begun."""
    one, two, three = some(1), some(2), some(3)
    store = GraphStore(spark, root, 4)
    store.merge("1", **batch(spark, *one))
    monkeypatch.setattr(GraphStore, "finish", lambda self: None)
    store.merge("2", **batch(spark, *two))
    monkeypatch.undo()
    assert store.batches() == ["1"] and rows(store.edges()) == brute(one)[0]
    assert exists(spark, f"{root}/_staged/batches")
    assert not store.merge("2", **batch(spark, *two)) and rows(store.edges()) == brute(one, two)[0]
    spark.range(3).write.parquet(f"{root}/_staged/edges")  # half a merge
    assert store.merge("3", **batch(spark, *three)) and rows(store.edges()) == brute(one, two, three)[0]


def test_null_keys_and_empty_batches(spark, root):
    store = GraphStore(spark, root, 4)
    assert rows(store.edges()) == [] and rows(store.nodes()) == [] and store.batches() == []
    assert store.merge("0", **batch(spark, [], []))
    odd = [(None, "c1", "DISCUSSED", "a", True, 1, 1.0), ("p1", "c1", "DISCUSSED", None, None, 2, 1.0), ("p1", "c1", "DISCUSSED", "b", None, 3, 1.0)]
    assert store.merge("1", **batch(spark, odd, [("PERSON", None), ("PERSON", "p1"), ("CONCEPT", "c1")]))
    assert rows(store.edges()) == [("p1", "c1", "DISCUSSED", "b", None, 5, 2.0)] and store.batches() == ["0", "1"]


def test_names_by_their_characters(spark, root):
    r = random.Random(8)
    names = [None, "", "a", "Ab", "abc", "ABCabc", "Ünï Cödé", "new york", "York New", "a%b_c", "xyzxyz"] + ["".join(r.choice("abcxyz ") for _ in range(r.randrange(1, 9))) for _ in range(60)]
    edges = [(r.choice(names), r.choice(names), r.choice(["DISCUSSED", "DISCUSSED", "CO_OCCURRENCE"]), f"c{i}", False, 1, 1.0) for i in range(400)]
    frame = spark.createDataFrame(edges + edges[:50], EDGE)
    index = NameIndex(spark, root).build(frame)
    for text in ("abc", "ABC", "bca", "xyzx", "york", "w y", "ï cö", "b_c", "%", "a", "", "zzzzzz", "ab"):
        assert rows(index.neighbours(text, None)) == rows(graph.neighbours(frame, text, None)), text
        assert [tuple(x) for x in index.neighbours(text, 4).collect()] == [tuple(x) for x in graph.neighbours(frame, text, 4).collect()]
    plan = index.neighbours("york", None)._jdf.queryExecution().toString()
    assert "In(entity" in plan or "EqualTo(entity" in plan
    empty = NameIndex(spark, f"{root}/e").build(frame.where("chunk_id = 'none'"))
    assert rows(empty.neighbours("abc")) == []


def test_many_names_are_joined(spark, root, monkeypatch):
    monkeypatch.setattr("strandline.operators.store.MOST_NAMES", 3)
    edges = [(f"name {i}", f"topic {i % 4}", "DISCUSSED", f"c{i}", False, 1, 1.0) for i in range(30)]
    frame = spark.createDataFrame(edges, EDGE)
    assert rows(NameIndex(spark, root).build(frame).neighbours("ame", None)) == rows(graph.neighbours(frame, "ame", None))


def test_paths_that_meet_in_the_middle(spark):
    """Against breadth-first search in plain loops: the least of all shortest paths, or none."""
    r = random.Random(5)
    pairs = sorted({tuple(r.sample([f"n{i:02d}" for i in range(26)], 2)) for _ in range(38)})
    frame = spark.createDataFrame([(a, b, "DISCUSSED", "c", False, 1, 1.0) for a, b in pairs], EDGE)
    links = defaultdict(set)
    for a, b in pairs:
        links[a].add(b)
        links[b].add(a)

    def least(start, end, hops):
        level, seen = {start: (start,)}, {start}
        for _ in range(hops):
            new = {}
            for path in level.values():
                for x in links[path[-1]] - seen:
                    new[x] = min(new.get(x, (*path, x)), (*path, x))
            if end in new:
                return list(new[end])
            seen |= new.keys()
            level = new
        return None

    lengths = set()
    for start, end, hops in [("n00", "n01", 4), ("n00", "n13", 4), ("n02", "n25", 6), ("n03", "n17", 3), ("n04", "n20", 2), (pairs[0][0], pairs[0][1], 1), ("n05", "zz", 4)]:
        want = least(start, end, hops)
        assert graph.shortest_path(frame, start, end, hops) == want
        lengths.add(want and len(want))
    assert len(lengths) > 2
    assert graph.shortest_path(frame, "n00", "n00", 4) == ["n00"]
