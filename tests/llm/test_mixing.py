import re
from collections import defaultdict

from strandline.llm import mixing, queries

from .odd import no_docs, odd_docs


def targets(sizes, most=3):
    """Water filling by the loop that the contract describes; sizes in order of source."""
    weights = [1 + i % 3 for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        w = sum(weights[i] for i in free)
        above = {i for i in free if left * weights[i] / w >= most * sizes[i]}
        if not above:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in above:
            out[i] = float(most * sizes[i])
            left -= out[i]
        free -= above
    return out


def test_targets_equal_the_loop(spark):
    cases = [[5, 100, 3, 40, 0, 900], [1], [0, 0], [10, 10, 10], [1, 1, 1, 1, 1000], [7, 0, 2000, 3, 3, 90, 1]]
    for sizes in cases:
        df = spark.createDataFrame([(f"s{i:02d}", n) for i, n in enumerate(sizes)], "source string, size long")
        got = [r.target for r in mixing.source_targets(df, source="source", size="size").orderBy("source").collect()]
        assert all(abs(a - b) < 1e-6 for a, b in zip(got, targets(sizes))), (sizes, got, targets(sizes))


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = queries.op3_mix_sources(spark, d).collect()
    assert len(rows) == len(docs)
    by, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text)) and r.taken <= 3 * r.size
        by[docs[r.doc_id].source] += r.size
        taken[docs[r.doc_id].source] += r.taken
    names = sorted(by)
    want = dict(zip(names, targets([by[s] for s in names])))
    assert all(abs(r.target - want[docs[r.doc_id].source]) < 1e-6 and r.source_size == by[docs[r.doc_id].source] for r in rows)
    assert abs(sum(taken.values()) / sum(by.values()) - 1) < 0.1
    assert sorted(rows) == sorted(queries.op3_mix_sources(spark, d).collect())


def test_odd_rows_many_sources_and_emitting(spark, monkeypatch):
    docs = odd_docs(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "score", "size", "source_size", "target", "copies", "taken"]
    rows = mixed.collect()
    assert len(rows) == 8 and {r.size for r in rows if r.doc_id in (2, 3, 4)} == {0}
    n = sum(r.copies for r in rows)
    assert mixing.emit(mixed, docs.columns[:5]).count() == n
    monkeypatch.setattr(mixing, "MOST_SENT", 1)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(mixing.mix(docs).collect(), key=key) == sorted(rows, key=key)
    assert mixing.mix(no_docs(spark)).count() == 0


def test_ranks_of_many_sources(spark):
    """Sources in several ranges, with null and empty names, rank as by one sort."""
    from strandline.llm.shelf import Shelf

    names = [None, "", "ä", "z", "Z", *(f"s{i * 7919 % 1000:04d}" for i in range(1000))]
    by = spark.createDataFrame([(x, 1) for x in names], "source string, n int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        rows = mixing.ranked(by, Shelf(spark, "test")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {x: i for i, x in enumerate(sorted(names, key=lambda x: (x is None, (x or "").encode())))}
    assert {r.source: r["rank"] for r in rows} == want and len(rows) == len(names)
