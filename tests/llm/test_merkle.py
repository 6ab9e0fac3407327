import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from strandline.llm import merkle

from .odd import ODD, no_docs, odd_docs


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, told=0):
    n = None if r.n_chars is None else r.n_chars + told
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, n, r.text)))


def told(r):
    return int(r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute(rows):
    """The contract, in plain loops."""
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in order}
    top, out = tree([trees[g][-1][0] for g in order]), []
    for no, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            now, others = leaf(r, told(r)), []
            for levels, at in ((trees[g], i), (top, no)):
                for level in levels[:-1]:
                    if at ^ 1 < len(level):
                        others.append(level[at ^ 1])
                        now = H(others[-1], now) if at & 1 else H(now, others[-1])
                    else:
                        now = H(now)
                    at >>= 1
            out.append((r.doc_id, leaf(r), trees[g][-1][0], top[-1][0], H(*others), now, now == top[-1][0]))
    return sorted(out, key=str)


def made(docs):
    change = docs["n_chars"] + F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)).cast("int")
    rows = merkle.manifest(docs, changed={"n_chars": change})
    rows = rows.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("p"), "folded_root", "verified")
    return sorted(map(tuple, rows.collect()), key=str)


def test_odd_rows(spark):
    docs = odd_docs(spark, ["a", "b", "", "the same"] * 3)
    assert made(docs) == brute(docs.collect())
    assert made(no_docs(spark)) == []


@pytest.mark.parametrize("n", [1, 2, 5])
def test_small_trees(spark, n):
    docs = spark.createDataFrame([(i, str(i), None if i % 4 else "en", None, i, 1, "s", "q") for i in range(n)], ODD)
    assert made(docs) == brute(docs.collect())


def test_rounds_and_repeats(spark, monkeypatch):
    """Arrays of four leaves: several rounds, a group that ends in a short array, many languages, thousands of equal rows."""
    monkeypatch.setattr(merkle, "BITS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = [(7, "again", "hot", "s", 5, 1, "", "")] * 1500 + [(None, "again", "hot", "s", None, 1, "", "")] * 70
    rows += [(i, f"text {i}", f"l{i % 37}", "s", i, 1, "", "") for i in range(333)]
    docs = spark.createDataFrame(rows, ODD).repartition(5)
    got = made(docs)
    assert got == brute(docs.collect()) and {r[-1] for r in got} == {True, False}


def test_fields_dont_run_together(spark):
    two = spark.createDataFrame([(1, "2:3", "x"), (1, "2", ":3x"), (1, None, "-"), (1, "-", None)], "a long, b string, c string")
    assert two.select(merkle.leaf_of([F.col("a"), F.col("b"), F.col("c")]).alias("h")).distinct().count() == 4
