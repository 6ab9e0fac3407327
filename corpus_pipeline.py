"""A training corpus from raw documents: stages in order, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``. An empty table goes through as
an empty one, and further columns of ``documents`` are kept up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, mixing, near_dedup, pii, toxicity
from strandline.llm.shelf import Shelf, free_name, table


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above go. A null text is scored as an empty one; repeated rows alike."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "toxicity")
    return toxicity.score(docs, model, out=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least id, null last. Texts without words all stay."""
    return near_dedup.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; ``n_chars`` follows the text. Rows without a span stay as they are, nulls too."""
    spans = free_name(docs, "pii_spans")
    found = pii.redact(pii.find_spans(docs, out=spans), spans=spans)
    chars = F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", chars).select(*docs.columns)


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated so that the sources' words meet their targets; rows that repeat an id are drawn alike."""
    aside = {c: free_name(docs, c) for c in docs.columns if c.lower() in mixing.MADE}  # names that mixing takes
    moved = docs.withColumnsRenamed(aside)
    return mixing.emit(mixing.mix(moved), moved.columns).withColumnsRenamed({v: k for k, v in aside.items()})


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, none for a null or empty text; ``exact`` says whether they decode to its bytes."""
    how = {"path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
    done = bpe.encode(docs, decoded="decoded", **how)
    exact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return done.select("doc_id", "lang", "source", "n_chars", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), exact.alias("exact"))


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("near_dedup", without_near_duplicates),
    ("pii", without_personal_data),
    ("mixing", mixed_to_weights),
    ("bpe", as_tokens),
]

#: Trained nets, near-duplicates and tokens aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    shelf = Shelf(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = shelf.put(stage(spark, docs, sf_dir))
    return docs
