import random
from collections import Counter
from dataclasses import replace

from strandline.operators import graph
from strandline.params import Params
from strandline.plans import sizes
from strandline.plans.queries import QUERIES

P = replace(Params(), min_guest_rows=3, min_concept_rows=4)


def made(spark):
    r = random.Random(5)
    names = list("abcdefghijkl")
    rows = [(i, r.sample(names, r.randrange(4)), r.sample(names, r.randrange(5)), r.randrange(1, 3), f"{i}-0001", i % 2 == 0) for i in range(25)]
    return rows, spark.createDataFrame(rows + [(None, ["a"], ["b"], 1, "x", False)], "episode_id long, guests array<string>, concepts array<string>, n_chunks long, last_chunk string, chaos boolean")


def test_valid_names_of_both_kinds_equal_plain_loops(spark, monkeypatch):
    rows, eps = made(spark)
    often = []
    for place, least in ((1, 3), (2, 4)):
        n = Counter()
        for row in [*rows, (None, ["a"], ["b"], 1)]:
            n.update({x: row[3] for x in row[place]})
        often.append({x for x, k in n.items() if k >= least})
    assert often[0] != often[1]
    kept = [(i, [x for x in g if x in often[0]], [x for x in c if x in often[1]]) for i, g, c, *_ in rows]
    want = sorted((i, g, c) for i, g, c in kept if c)
    assert len(want) < len(rows)
    for most in (sizes.MOST, 0):
        monkeypatch.setattr(sizes.sent_if_small, "__defaults__", (most,))
        valid = graph.valid_episodes(eps, P)
        assert sorted((r.episode_id, r.guests, r.concepts) for r in valid.collect()) == want
        for nodes in (None, graph.nodes(eps, P)):
            assert sorted(map(tuple, graph.upserted(valid, nodes).collect())) == sorted(map(tuple, graph.folded(valid).collect())) != []
        assert sorted(map(tuple, graph.valid_episodes(eps, P, graph.nodes(eps, P)).collect())) == sorted(map(tuple, valid.collect()))
    some = graph.nodes(eps, P).where("id < 'f'")
    ends = {(r.id, r.type) for r in some.collect()}
    all_ = graph.folded(valid).collect()
    inside = [tuple(r) for r in all_ if (r.source, "PERSON" if r.type == "DISCUSSED" else "CONCEPT") in ends and (r.target, "CONCEPT") in ends]
    assert sorted(map(tuple, graph.upserted(valid, some).collect())) == sorted(inside) and 0 < len(inside) < len(all_)


def broadcasts(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("BroadcastExchange")


def test_names_pass_through_the_driver_once(spark, sf_dir, monkeypatch):
    assert broadcasts(QUERIES["edge_upsert"](spark, sf_dir)) == 1
    monkeypatch.setattr(sizes.sent_if_small, "__defaults__", (10,))
    assert broadcasts(QUERIES["edge_upsert"](spark, sf_dir)) == 0


def test_a_table_beyond_the_check_is_never_broadcast(spark):
    left, right = spark.range(1000).toDF("k"), spark.range(50).toDF("k")
    assert broadcasts(left.join(sizes.sent_if_small(right, 49), "k")) == 0 and broadcasts(left.join(sizes.sent_if_small(right, 50), "k")) == 1
