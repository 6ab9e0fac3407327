import builtins
import sys

import __spark_entry__ as entry


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["doc_id", "chaos_score"] and rows.count() == 10


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_optional_part(spark, monkeypatch):
    real = builtins.__import__

    def fails(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith(("strandline.llm", "corpus_pipeline")):
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", fails)
    for m in [m for m in sys.modules if m.startswith(("strandline.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, m)
    assert "sentence_stats" in entry.queries() and not [q for q in entry.queries() if q.startswith("op") or q == "pipeline"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_python_in_the_plans(spark):
    for name in ("sentence_stats", "chaos_score", "chunk_features", "top_concepts", "ngram_doc_freq", "edge_upsert", "knn_topk"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct")), name


def test_scans_read_only_what_is_used(spark):
    plan = entry.queries()["sentence_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
