import base64
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from strandline.llm import pii, queries
from strandline.llm.shelf import Shelf

from .odd import odd_docs
from .test_mixing import targets
from .test_near_dedup import brute as components
from .test_pii import brute as base_spans

D = "/root/testdata/sf0.01"


def key(r):
    return tuple((x is None, x) for x in r)


def test_each_stage_against_brute_force(spark):
    shelf = Shelf(spark, "test")
    docs = shelf.put(spark.read.parquet(f"{D}/documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "pii", "mixing", "bpe"]

    def step(name, docs):
        out = shelf.put(stages[name](spark, docs, D))
        assert name == "bpe" or out.schema.names == docs.schema.names == ["doc_id", "text", "lang", "source", "n_chars"]
        return out, [tuple(r) for r in docs.collect()], [tuple(r) for r in out.collect()]

    out, before, after = step("toxicity", docs)
    bad = {r.doc_id for r in queries.op8_toxicity(spark, D).collect() if r.predicted}
    assert bad and sorted(after, key=key) == sorted((r for r in before if r[0] not in bad), key=key)

    out, before, after = step("near_dedup", out)
    named = {k for k, n, c in components([r[:2] for r in before]) if not n or k == c}
    assert sorted(after, key=key) == sorted((r for r in before if r[0] in named), key=key) and len(after) < len(before)

    out, before, after = step("pii", out)
    was, changed = {r[0]: r for r in before}, 0
    for r in after:
        old = was[r[0]][1]
        spans = base_spans(old)
        assert r[4] == len(r[1]) or r == was[r[0]]
        if not spans and "[" not in r[1]:
            assert r == was[r[0]]
        elif spans:
            changed += 1
            assert not base_spans(r[1]) and re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r[1])
    assert changed and len(after) == len(before)

    out, before, after = step("mixing", out)
    n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    size, taken = Counter(), Counter()
    for r in before:
        size[r[3]] += n(r[1])
    for r in after:
        taken[r[3]] += n(r[1])
    copies = Counter(r[0] for r in after)
    assert set(after) <= set(before) and max(copies.values()) <= 3
    for s, want in zip(sorted(size), targets([size[s] for s in sorted(size)])):
        rate = want / size[s]
        assert all(copies[r[0]] in (int(rate), int(rate) + 1) for r in before if r[3] == s)

    out, before, after = step("bpe", out)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}, special_tokens={})
    ids = {r[0]: enc.encode_ordinary(r[1]) for r in before}
    rows = out.collect()
    assert len(rows) == len(before) and all(list(r.token_ids) == ids[r.doc_id] and r.n_tokens == len(ids[r.doc_id]) and r.exact for r in rows)
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, D).collect()) == Counter(r.doc_id for r in rows)


def test_odd_rows_go_through(spark):
    docs = odd_docs(spark, ["mail to a@b.cc please do it now", "Mail to a@b.cc please do it now"])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        rows = out.collect()
        if name in ("near_dedup", "pii"):
            assert out.columns == docs.columns
            ids = Counter(r.doc_id for r in rows)
            if name == "near_dedup":
                assert ids == Counter([1, 2, 3, 4, 5, 6, None, 100])
            else:
                assert len(rows) == 10 and {r.text for r in rows if r.doc_id == 100} == {"mail to [EMAIL] please do it now"}
        empty = docs.where("doc_id = -5")
        assert stage(spark, empty, D).count() == 0


def test_clashing_names_are_kept(spark):
    """Columns named like those that stages make, in any case, come out as they went in, up to the last stage."""
    names = ["Size", "Copies", "TARGET", "Decoded", "Token_IDs", "Toxicity", "PII_Spans", "D1", "Set"]
    docs = odd_docs(spark).drop("size", "slot", "score")
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.concat(F.lit(f"{i}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        rows = out.collect()
        assert rows
        if name != "bpe":
            assert out.columns == docs.columns
            assert all(r[n] == f"{i}:{'none' if r.doc_id is None else r.doc_id}" for r in rows for i, n in enumerate(names))


def test_redaction_finds_all_base_kinds():
    assert set(pii.BASE) == {"email", "ip", "card", "phone"}
