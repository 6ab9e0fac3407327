"""The queries over the test tables, each with SQL for another engine.

``documents`` stand in for episodes, ``source`` for the guest and frequent words
for concepts. The word lists are chosen so that every rule has both outcomes on
these tables; the lists of ``Params()`` hardly occur in them.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as s
from ..functions import text as t
from ..functions.providers import lexicon_sentiment
from ..operators import boundaries, bulk, chunk, clean, enrich, graph, ingest, learned, lemmas, lexicon, proper, report, sentiment as moods, terms, vectors
from ..operators.agent import graph_facts, hybrid
from ..operators.store import GraphStore, NameIndex
from ..params import Lexicons, Params
from ..sources import files, sinks
from ..sources.files import table
from ..sources.shelf import Shelf, spread
from ..streaming.ingest import windowed_events

LEXICONS = replace(
    Lexicons(),
    sponsors=("license", "the and"),
    keywords=("reserved", "software", "thanedble"),
    boilerplate=("the", "eriner thanea", "all rights reserved"),
    safe_starters=("the ", "of ", "der ", "que "),
    visual_triggers=("the and", "worthless", "que", "die der"),
    chunk_visual_triggers=("worthless", "license", "pathetic"),
    host_markers=("the", "and", "die", "que", "license"),
    extra_marker="worthless",
)
PARAMS = Params(lexicons=LEXICONS, chaos_cut=8.0)
MOODS = {"worthless": -1.0, "pathetic": -0.5, "the": 0.25, "und": 0.5}


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, f"{sf_dir}/documents.parquet")


def _body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_docs(spark, sf_dir).select("doc_id", "source", "text"))


def _toxic(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mined phrases, written once."""
    return Shelf(spark, "toxic").put(clean.toxic_phrases(docs, PARAMS, text="text", key="doc_id"))


def sentence_stats(spark, sf_dir):
    st = enrich.sentence_stats(F.col("text"), PARAMS)
    return _body(spark, sf_dir).select("doc_id", st.alias("x")).select("doc_id", "x.n_sentences", "x.n_words", "x.n_long", "x.long_words")


def _features(spark, sf_dir, *columns):
    return enrich.features(_body(spark, sf_dir), PARAMS, text="text", sentiment=lexicon_sentiment(MOODS)).select("doc_id", *columns)


def chaos_score(spark, sf_dir):
    return _features(spark, sf_dir, "chaos_score")


def high_chaos_topk(spark, sf_dir):
    return enrich.most(chaos_score(spark, sf_dir), "chaos_score", "doc_id", 10)


def complexity_score(spark, sf_dir):
    return _features(spark, sf_dir, "complexity_score")


def sentiment(spark, sf_dir):
    return _features(spark, sf_dir, "sentiment")


def phrase_hits(spark, sf_dir):
    return _features(spark, sf_dir, "visual_event_count")


def business_start(spark, sf_dir):
    return _features(spark, sf_dir, "business_start_index")


def top_concepts(spark, sf_dir):
    own = _body(spark, sf_dir).where(F.length("text") >= PARAMS.min_feature_chars)
    return enrich.ranked_concepts(own, PARAMS, key="doc_id", text="text")


def ngram_doc_freq(spark, sf_dir):
    return clean.phrase_frequency(_body(spark, sf_dir), PARAMS, text="text", key="doc_id")


def toxic_phrases(spark, sf_dir):
    return clean.toxic_phrases(_body(spark, sf_dir), PARAMS, text="text", key="doc_id")


def ad_sentence_rules(spark, sf_dir):
    docs = _body(spark, sf_dir)
    rules = clean.sentence_rules(docs, _toxic(spark, docs), PARAMS, text="text", key="doc_id")
    n = lambda k: F.sum((F.col("rule") == k).cast("long")).alias(f"rule_{k}")
    return rules.groupBy("doc_id").agg(*(n(k) for k in range(4)))


def _silver(spark, sf_dir):
    docs = _body(spark, sf_dir)
    return clean.silver(docs, _toxic(spark, docs), PARAMS, text="text", key="doc_id")


def clean_text_digest(spark, sf_dir):
    return _silver(spark, sf_dir).select("doc_id", F.md5("content_body").alias("digest"), F.length("content_body").cast("long").alias("chars"), "ads_removed_count")


def silver_summary(spark, sf_dir):
    found = _silver(spark, sf_dir)
    return found.agg(F.count(F.lit(1)).alias("docs"), F.sum("ads_removed_count").alias("removed"), s.round2(F.avg("ads_removed_count")).alias("mean_removed"))


def chunk_bounds(spark, sf_dir):
    return chunk.exploded(_body(spark, sf_dir), PARAMS, text="text").select("doc_id", "ordinal", "first", "last", F.length("text_content").cast("long").alias("chars"))


def _plain_chunks(spark, sf_dir):
    """Chunks without concepts, for what doesn't need them: no exchange."""
    docs = _features(spark, sf_dir, "text", "chaos_score", "business_start_index")
    return chunk.chunks(docs.withColumns({"nlp_guests": F.array().cast("array<string>"), "top_concepts": F.array().cast("array<string>")}), PARAMS, key="doc_id", text="text")


def chunk_features(spark, sf_dir):
    return _plain_chunks(spark, sf_dir).select("chunk_id", "stage", "host_probability", "has_visual_context", "episode_chaos", F.md5("text_content").alias("digest"))


def host_corpus(spark, sf_dir):
    return chunk.host_corpus(_plain_chunks(spark, sf_dir), PARAMS).select("meta.chunk_id", "meta.stage", "meta.score", F.md5("text").alias("digest"))


def visual_corpus(spark, sf_dir):
    return chunk.visual_corpus(_plain_chunks(spark, sf_dir)).select("meta.chunk_id", F.md5("text").alias("digest"))


def _episodes(spark, sf_dir):
    """Documents as episodes, written once; the source is the only guest."""
    gold = enrich.gold(_body(spark, sf_dir), PARAMS, text="text").withColumn("guests", F.array("source"))
    return Shelf(spark, "episodes").put(graph.episodes_of(gold, PARAMS, key="doc_id", text="text", guests="guests"))


def valid_concepts(spark, sf_dir):
    return graph.frequent(_episodes(spark, sf_dir), "concepts", PARAMS.min_concept_rows)


def graph_nodes(spark, sf_dir):
    return graph.nodes(_episodes(spark, sf_dir), PARAMS)


def _edges(spark, sf_dir):
    return graph.edges_of(graph.valid_episodes(_episodes(spark, sf_dir), PARAMS))


def edges_discussed(spark, sf_dir):
    return _edges(spark, sf_dir).where("type = 'DISCUSSED'")


def edges_cooccur(spark, sf_dir):
    return _edges(spark, sf_dir).where("type = 'CO_OCCURRENCE'")


def edge_upsert(spark, sf_dir):
    return graph.upserted(graph.valid_episodes(_episodes(spark, sf_dir), PARAMS))


def topic_authority(spark, sf_dir):
    return graph.topic_authority(edge_upsert(spark, sf_dir), "that", 5)


def chaos_edges(spark, sf_dir):
    return graph.chaos_edges(_edges(spark, sf_dir))


def entity_neighbors(spark, sf_dir):
    return graph.neighbours(_edges(spark, sf_dir), "SRC1", 10)


def shortest_connection(spark, sf_dir):
    path = graph.shortest_path(edge_upsert(spark, sf_dir), "src0", "src1", PARAMS.max_hops) or []
    return spark.createDataFrame([(i, x) for i, x in enumerate(path)], "hop int, id string")


def _vectors(spark, sf_dir):
    return vectors.vector_table(table(spark, f"{sf_dir}/embeddings.parquet"))


def vector_norms(spark, sf_dir):
    raw = table(spark, f"{sf_dir}/embeddings.parquet")
    return raw.select("vec_id", F.round(s.norm(F.col("embedding")), 5).alias("length"), F.round(s.norm(s.normalised(F.col("embedding"))), 5).alias("unit_length"))


def _hits(spark, sf_dir):
    """The rows whose id is divisible by 100 against all others."""
    own = _vectors(spark, sf_dir)
    asked = own.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"))
    return vectors.nearest_each(own, asked, 3)


def knn_topk(spark, sf_dir):
    return _hits(spark, sf_dir).select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


def knn_label_agreement(spark, sf_dir):
    return vectors.label_agreement(_hits(spark, sf_dir), table(spark, f"{sf_dir}/embeddings.parquet"))


def knn_centroids(spark, sf_dir):
    """The rows nearest to the mean of each label."""
    own = _vectors(spark, sf_dir)
    return vectors.nearest_each(own, vectors.centroids(own), 3, own=True).select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


def graph_schema(spark, sf_dir):
    own = _episodes(spark, sf_dir)
    nodes = Shelf(spark, "schema").put(graph.nodes(own, PARAMS))
    return files.graph_schema(nodes, graph.edges_of(graph.valid_episodes(own, PARAMS, nodes)))


def merged_nodes(spark, sf_dir):
    """Persons are in both parts."""
    own = graph.nodes(_episodes(spark, sf_dir), PARAMS)
    return graph.merged_nodes(own, own.where("type = 'PERSON'"))


def episode_rows(spark, sf_dir):
    """Episodes again from their chunks, of which only some have a guest list."""
    gold = enrich.gold(_body(spark, sf_dir), PARAMS, text="text").withColumn("nlp_guests", F.array("source"))
    some = F.when(F.col("chunk_id") >= F.concat("episode_id", F.lit("-0001")), F.col("guest_list"))
    chunks = chunk.chunks(gold, PARAMS, key="doc_id", text="text").withColumn("guest_list", some)
    return graph.episodes(chunks, PARAMS).select("episode_id", F.array_join("guests", ",").alias("guests"), F.array_join("concepts", ",").alias("concepts"), "n_chunks", "last_chunk", "chaos")


def nlp_guests(spark, sf_dir):
    return _silver(spark, sf_dir).select("doc_id", F.array_join("nlp_guests", "|").alias("guests"))


def sampled_phrases(spark, sf_dir):
    """Phrases of a fixed sample of 300 documents: the sampling operator."""
    return clean.phrase_frequency(_body(spark, sf_dir), replace(PARAMS, mining_sample=300), text="text", key="doc_id")


def bronze_rows(spark, sf_dir):
    """Documents as raw files."""
    raw = filename_metadata_of(_docs(spark, sf_dir)).select("name", F.col("text").cast("binary").alias("content"))
    return ingest.bronze(raw, PARAMS).select("episode_id", "original_filename", "show_type", "guest_draft", F.md5("raw_text").alias("digest"), F.size("sentences").cast("long").alias("n_sentences"))


def audit_lines(spark, sf_dir):
    found = raw_audit(spark, sf_dir)
    return ingest.audit_report(found)


def audit_summary(spark, sf_dir):
    return ingest.audit_summary(raw_audit(spark, sf_dir))


def bare_replies(spark, sf_dir):
    """Turns as a model would fence them, without the fence."""
    talks = table(spark, f"{sf_dir}/conversations.parquet")
    fenced = F.concat(F.lit("```cypher\n"), F.trim("text"), F.lit("\n```"))
    return talks.select("conv_id", "turn", "role", F.md5(t.without_fences(fenced)).alias("digest"))


def exports(spark, sf_dir):
    """Each writer's files, read again: kind, rows and the sum of ids."""
    shelf = Shelf(spark, "exports")
    rows = _docs(spark, sf_dir).select("doc_id", "lang", F.concat(F.lit('a "quoted", '), F.col("source")).alias("source"))
    sinks.parquet(rows, f"{shelf.root}/p", rows_per_file=100, by=["lang"])
    sinks.csv(rows, f"{shelf.root}/c")
    sinks.jsonl(rows, f"{shelf.root}/j")
    sinks.lines(rows.select(F.concat_ws("\t", F.col("doc_id").cast("string"), "source").alias("value")), f"{shelf.root}/l")
    line = F.split("value", "\t")
    again = {
        "csv": spark.read.csv(f"{shelf.root}/c", schema=rows.schema, header=True, escape='"').select("doc_id", "source"),
        "jsonl": spark.read.schema(rows.schema).json(f"{shelf.root}/j").select("doc_id", "source"),
        "lines": spark.read.text(f"{shelf.root}/l").select(line[0].cast("long").alias("doc_id"), line[1].alias("source")),
        "parquet": spark.read.parquet(f"{shelf.root}/p").select("doc_id", "source"),
    }
    each = [df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"), F.sum(F.length("source").cast("long")).alias("chars")) for kind, df in again.items()]
    return reduce(DataFrame.union, each)


def history_window(spark, sf_dir):
    return report.last_turns(table(spark, f"{sf_dir}/conversations.parquet")).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


def steps_report(spark, sf_dir):
    talks = table(spark, f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.collect_set("role").alias("steps"))
    return talks.agg(F.count(F.lit(1)).alias("runs"), s.round2(100 * F.avg(F.array_contains("steps", "system").cast("int"))).alias("rate"))


def latency_report(spark, sf_dir):
    kinds = table(spark, f"{sf_dir}/events.parquet")
    return report.benchmark_summary(kinds.select(F.col("value").alias("Latency (s)"), (F.col("event_type") == "click").alias("Self-Corrected")))


def trace_report(spark, sf_dir):
    events = table(spark, f"{sf_dir}/events.parquet")
    traces = events.select(
        F.col("event_id").alias("trace_id"), (F.col("event_type") != "view").alias("is_root"), F.col("event_type").alias("question"), F.lit(None).cast("string").alias("answer"),
        F.lit("success").alias("status"), F.col("ts").alias("start_time"), F.timestamp_add("MILLISECOND", (F.col("value") * 1000).cast("long"), F.col("ts")).alias("end_time"),
    )
    from ..sources.files import recent_traces

    recent = recent_traces(traces, 20)
    return report.trace_report(recent).withColumnsRenamed({"Input": "input", "Output": "output", "Latency": "latency", "Status": "status"})


def token_count(spark, sf_dir):
    return report.token_estimate(_docs(spark, sf_dir))


def filename_metadata_of(docs):
    """With ``name``, a file name of each of the known forms in turn."""
    name = F.concat(
        F.element_at(F.array(*map(F.lit, ("The Experience #", "MMA Show #", "the experience  #", "Best of #"))), (F.col("doc_id") % 4 + 1).cast("int")),
        F.col("doc_id").cast("string"),
        F.element_at(F.array(*map(F.lit, (" - ", " with ", "-", " - with "))), (F.col("doc_id") % 4 + 1).cast("int")),
        F.col("source"),
        F.element_at(F.array(*map(F.lit, (".txt", " (Part Two).txt", " (part 3) .txt"))), (F.col("doc_id") % 3 + 1).cast("int")),
    )
    return docs.withColumn("name", name)


def filename_metadata(spark, sf_dir):
    return filename_metadata_of(_docs(spark, sf_dir)).select("name", ingest.file_metadata(F.col("name")).alias("m")).select("name", "m.*")


def raw_audit(spark, sf_dir):
    pages = table(spark, f"{sf_dir}/pages.parquet")
    content = F.col("html").cast("binary")
    files = pages.select(F.concat_ws("#", "url", F.col("page_id").cast("string")).alias("name"), F.octet_length(content).cast("long").alias("length"), content.alias("content"))
    return ingest.audit(files, 1500)


def hybrid_retrieval(spark, sf_dir):
    own = _vectors(spark, sf_dir)
    query = [r.x for r in own.select(F.posexplode("vector").alias("pos", "v")).groupBy("pos").agg(F.avg(F.col("v").cast("double")).alias("x")).orderBy("pos").collect()]
    near = vectors.nearest(own, query, 3, key="vec_id")
    hits = near.select(F.concat(F.lit("label "), F.col("label").cast("string")).alias("text"), F.col("vec_id").cast("string").alias("chunk_id"), F.lit(0.0).alias("chaos"))
    return hybrid(graph_facts(entity_neighbors(spark, sf_dir)), hits)


def preview(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", t.preview(F.col("text")).alias("preview"))


def events_by_day(spark, sf_dir):
    return windowed_events(table(spark, f"{sf_dir}/events.parquet")).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def graph_store_merge(spark, sf_dir):
    """The upserted edges again, from a store that took the episodes in two batches, one of them twice."""
    own = _episodes(spark, sf_dir)
    shelf = Shelf(spark, "graph")
    nodes = shelf.put(graph.nodes(own, PARAMS))
    valid = shelf.put(graph.valid_episodes(own, PARAMS, nodes))
    store = GraphStore(spark, f"{shelf.root}/store", buckets=16)
    half = F.pmod(F.xxhash64("episode_id"), F.lit(2))
    for part in (1, 0, 1):
        store.merge(f"half {part}", nodes=nodes, edges=graph.folded(valid.where(half == part)))
    return store.edges()


#: Parts of names: of persons, of concepts, in another case, of two characters, and of none.
ASKED = ("SRC1", "rc0", "tha", "HE", "zzzz")


def indexed_neighbors(spark, sf_dir):
    """Neighbours of all names that contain a text, by the index of names."""
    index = NameIndex(spark, Shelf(spark, "names").root).build(_edges(spark, sf_dir))
    return reduce(DataFrame.union, [index.neighbours(a, None).withColumn("asked", F.lit(a)) for a in ASKED]).groupBy("asked", "entity", "connected_to").agg(F.count(F.lit(1)).alias("n"), F.min("chunk").alias("first_chunk"))


def lexicon_hits(spark, sf_dir):
    """Runs of three words of the benchmark's items, as a lexicon, in all documents."""
    runs = table(spark, f"{sf_dir}/benchmark.parquet").select(F.explode(t.ngrams(t.words(F.col("text")), 3)).alias("phrase"))
    return lexicon.hits(_body(spark, sf_dir).select("doc_id", F.lower("text").alias("text")), runs)


def lexicon_documents(spark, sf_dir):
    """Documents with one of the longer words of the benchmark's items, inside words too."""
    long = table(spark, f"{sf_dir}/benchmark.parquet").select(F.explode(t.words(F.col("text"))).alias("phrase")).where(F.length("phrase") >= 9)
    docs = _body(spark, sf_dir).select("doc_id", F.lower("text").alias("text"))
    return lexicon.with_any(docs, long).select("doc_id").join(lexicon.occurrences(docs, long), "doc_id")


def knn_parts(spark, sf_dir):
    """Parts of like size and price: two dimensions, so most cells are never visited."""
    own = table(spark, f"{sf_dir}/part.parquet").select("p_partkey", F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")).alias("vector"))
    asked = own.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.col("vector").alias("query"))
    return vectors.nearest_each(own, asked, 5, key="p_partkey").withColumn("distance", F.round("distance", 6))


#: Words of the vectors that are learned: those in a hundredth of the documents.
LEARNING = learned.Learning(share=0.01)


def _pairs(spark, sf_dir):
    """Pairs of frequent words as text, with their counts and mutual information, written once."""
    docs, shelf = _body(spark, sf_dir), Shelf(spark, "pairs")
    words = sorted(r.word for r in learned.vocabulary(docs, LEARNING).limit(LEARNING.most).collect())
    pairs = shelf.put(learned.pair_counts(docs, words, LEARNING))
    told = spark.createDataFrame(list(enumerate(words)), "i long, word string")
    of = lambda c: told.select(F.col("i").alias(c), F.col("word").alias(f"word_{c}"))
    both = pairs.join(learned.mutual_information(pairs), ["a", "b"], "left").join(F.broadcast(of("a")), "a").join(F.broadcast(of("b")), "b")
    return shelf.put(both.select("word_a", "word_b", "n", F.coalesce("m", F.lit(0.0)).alias("m")))


def word_pairs(spark, sf_dir):
    """How often two frequent words stand within four words of each other, and their mutual information."""
    return _pairs(spark, sf_dir).withColumn("m", F.round("m", 6))


def _mood(spark, sf_dir):
    """The moods of a few words, spread over the pairs."""
    pairs = _pairs(spark, sf_dir).where("m > 0").select(F.col("word_a").alias("a"), F.col("word_b").alias("b"), "m")
    return moods.induced(pairs, spark.createDataFrame(list(MOODS.items()), "word string, score double"))


def induced_lexicon(spark, sf_dir):
    """Scores of words near the seed words."""
    return _mood(spark, sf_dir).withColumn("score", F.round("score", 6))


def induced_sentiment(spark, sf_dir):
    """Each document's mean score by the induced lexicon, with negations and intensifiers."""
    found = moods.scored(_body(spark, sf_dir), _mood(spark, sf_dir), negations=("of", "que"), intensifiers=("that", "der"))
    return found.withColumn("score", F.round("score", 6))


def learned_neighbors(spark, sf_dir):
    """The three documents nearest to each with an id divisible by 100, by vectors learned from all documents."""
    docs = _body(spark, sf_dir)
    found = Shelf(spark, "learned").put(learned.embedded(docs.select("doc_id", "text"), learned.fit(docs, LEARNING), text="text").drop("text"))
    asked = found.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query"))
    return vectors.nearest_each(found, asked, 3, key="doc_id").withColumn("distance", F.round("distance", 6))


def abbreviation_scores(spark, sf_dir):
    """Words that stand with a period as a rule."""
    return boundaries.abbreviations(_body(spark, sf_dir), least=1e-5).withColumn("score", F.round("score", 6))


def learned_sentences(spark, sf_dir):
    """Each document's sentences, split by the abbreviations of all documents: how many, and a digest of their places."""
    docs = _body(spark, sf_dir)
    short = Shelf(spark, "short").put(boundaries.abbreviations(docs).select("word"))
    found = boundaries.with_sentences(docs.select("doc_id", "text"), short)
    return found.select("doc_id", F.size("sentences").cast("long").alias("n"), F.md5(F.array_join(F.transform("sentences", lambda s: s["end"].cast("string")), ",")).alias("ends"))


def case_names(spark, sf_dir):
    """Words that are capitalised inside sentences nearly always."""
    return proper.name_words(proper.case_counts(_body(spark, sf_dir)), share=0.5)


def document_names(spark, sf_dir):
    """Each document's names by letter case."""
    docs = _body(spark, sf_dir)
    words = Shelf(spark, "names").put(proper.name_words(proper.case_counts(docs), share=0.5).select("word"))
    return proper.with_names(docs.select("doc_id", "text"), words, most=PARAMS.max_guests).select("doc_id", F.array_join("names", "|").alias("names"))


def _terms(spark, sf_dir):
    return terms.term_table(_body(spark, sf_dir), stop=LEXICONS.stop_concepts)


def concept_terms(spark, sf_dir):
    """Concepts of several words, with C-value and association."""
    return _terms(spark, sf_dir).withColumns({"cvalue": F.round("cvalue", 6), "association": F.round("association", 6)})


def document_concepts(spark, sf_dir):
    """The eight most frequent of the better concepts in each document."""
    shelf = Shelf(spark, "concepts")
    docs = shelf.put(_body(spark, sf_dir).select("doc_id", terms.lines(F.col("text")).alias("words")))
    every = terms.term_table(docs, words="words", stop=LEXICONS.stop_concepts)
    good = shelf.put(every.where("cvalue > 3 AND association > 0.1").select("term"))
    return terms.document_terms(docs, good, words="words", k=PARAMS.max_concepts, stop=LEXICONS.stop_concepts)


def lemma_pairs(spark, sf_dir):
    """Words with the lemma that the corpus' endings show."""
    return lemmas.lemma_table(_body(spark, sf_dir))


def complexity_by_lemmas(spark, sf_dir):
    """The complexity score with lemmas in place of words."""
    docs = _body(spark, sf_dir)
    table_ = Shelf(spark, "lemmas").put(lemmas.lemma_table(docs))
    st = enrich.sentence_stats(F.col("text"), PARAMS)
    own = docs.select("doc_id", (F.length("text") >= PARAMS.min_feature_chars).alias("long"), lemmas.letters(F.col("text")).alias("all"), st.alias("x"))
    own = own.select("doc_id", "long", "x", F.size("all").alias("letters"), F.array_distinct("all").alias("words"))
    own = lemmas.with_distinct_lemmas(own, table_, words="words")
    mean = F.when(F.col("x.n_long") > 0, F.col("x.long_words") / F.col("x.n_long"))
    score = F.when(F.col("letters") > 0, F.col("lemmas") / F.col("letters")).otherwise(0.0) * 100 + mean * 0.5
    return own.select("doc_id", "lemmas", F.when(F.col("long") & (F.col("x.n_long") > 0), s.round2(score)).otherwise(0.0).alias("complexity"))


def bulk_answers(spark, sf_dir):
    """Every user turn as a question: to the graph of the documents, and to the benchmark's items as chunks."""
    own, shelf = _episodes(spark, sf_dir), Shelf(spark, "answers")
    nodes = shelf.put(graph.nodes(own, PARAMS))
    valid = shelf.put(graph.valid_episodes(own, PARAMS, nodes))
    edges = shelf.put(graph.upserted(valid))
    items = table(spark, f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("chunk_id"), F.col("text").alias("text_content"), F.lit(0.0).alias("episode_chaos"))
    tables = {"nodes": nodes, "edges": edges, "upserted": edges, "vectors": shelf.put(vectors.embedded(items))}
    turns = table(spark, f"{sf_dir}/conversations.parquet").where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("text").alias("question"))
    done = bulk.answered(tables, turns, lambda df: vectors.embedded(df, text="question"))
    return done.select("id", F.array_join("steps", ">").alias("steps"), F.size("context").cast("long").alias("sources"), F.md5("answer").alias("answer"))


QUERIES = {
    f.__name__: f
    for f in (
        sentence_stats, chaos_score, high_chaos_topk, complexity_score, sentiment, phrase_hits, business_start, top_concepts,
        ngram_doc_freq, toxic_phrases, ad_sentence_rules, clean_text_digest, silver_summary, chunk_bounds, chunk_features,
        host_corpus, visual_corpus, valid_concepts, graph_nodes, edges_discussed, edges_cooccur, edge_upsert, topic_authority,
        chaos_edges, entity_neighbors, shortest_connection, vector_norms, knn_topk, knn_label_agreement, history_window,
        steps_report, latency_report, trace_report, token_count, filename_metadata, raw_audit, hybrid_retrieval, preview, events_by_day,
        knn_centroids, graph_schema, merged_nodes, episode_rows, nlp_guests, sampled_phrases, bronze_rows, audit_lines, audit_summary,
        bare_replies, exports, graph_store_merge, indexed_neighbors, lexicon_hits, lexicon_documents, knn_parts,
        word_pairs, learned_neighbors, abbreviation_scores, learned_sentences, case_names, document_names, concept_terms, document_concepts, bulk_answers, lemma_pairs, complexity_by_lemmas, induced_lexicon, induced_sentiment,
    )
}
