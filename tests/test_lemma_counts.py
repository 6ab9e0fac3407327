import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import lemmas
from strandline.plans.queries import QUERIES

from .test_lemmas import corpus


@pytest.mark.parametrize("sent", [lemmas.MOST_SENT, 0])
def test_counts_in_tasks_equal_the_join(spark, monkeypatch, sent):
    monkeypatch.setattr(lemmas, "MOST_SENT", sent)
    docs = spark.createDataFrame(corpus() + [(93, "12 _ 3"), (94, "walk walked stone stone king")], "doc_id long, text string").repartition(3)
    table = lemmas.lemma_table(docs, support=5).cache()
    want = {r.doc_id: r.lemmas for r in lemmas.distinct_lemmas(docs, table).collect()}
    assert want[92] == 1 and want[94] == 3 and table.count() > 10
    own = docs.withColumn("words", F.array_distinct(lemmas.letters(F.col("text"))))
    got = {r.doc_id: r.lemmas for r in lemmas.with_distinct_lemmas(own, table, words="words").collect()}
    assert got == {r.doc_id: want.get(r.doc_id, 0) for r in docs.collect()} and got[90] == got[91] == got[93] == 0
    assert sum(r.lemmas for r in lemmas.with_distinct_lemmas(own, table.limit(0), words="words").collect()) == sum(r.n for r in own.select(F.coalesce(F.size("words"), F.lit(0)).alias("n")).collect())
    assert lemmas.with_distinct_lemmas(own.where("doc_id < 0"), table, words="words").count() == 0


def test_words_with_an_equal_first_number_are_told_apart():
    table = lemmas.Numbered(np.array([[5, 5, -3, 5], [9, 2, 1, 4], [10, 11, 12, 13], [20, 21, 22, 23]], np.int64))
    h, g = np.array([5, 5, 5, 5, -3, 7], np.int64), np.array([2, 9, 3, 4, 1, 7], np.int64)
    x, y = table.lemmas(h, g)
    assert x.tolist() == [11, 10, 5, 13, 12, 7] and y.tolist() == [21, 20, 3, 23, 22, 7]


def test_no_text_is_joined(spark, sf_dir):
    df = QUERIES["complexity_by_lemmas"](spark, sf_dir)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
