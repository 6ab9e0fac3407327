import json

import pytest
from pyspark.sql import functions as F

from strandline import schemas
from strandline.operators import chunk, ingest
from strandline.operators.clean import phrase_frequency
from strandline.params import Params
from strandline.session import session
from strandline.sources import files, sinks
from strandline.sources.prompt_list import PROMPTS
from strandline.streaming import ingest as stream


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "raw" / "deeper").mkdir(parents=True)
    (tmp_path / "raw" / "The Experience #1 - Ann Lee.txt").write_text("Hello there. This is one.\nTwo lines? Yes!" * 30)
    (tmp_path / "raw" / "Odd & bad.txt").write_bytes(b"bad \xff\xfe bytes")
    (tmp_path / "raw" / "skip.md").write_text("no")
    (tmp_path / "raw" / "deeper" / "below.txt").write_text("no")
    return tmp_path


def test_raw_files_to_bronze(spark, folder):
    found = files.text_files(spark, str(folder / "raw"))
    rows = {r.original_filename: r for r in ingest.bronze(found).collect()}
    assert set(rows) == {"The Experience #1 - Ann Lee.txt", "Odd & bad.txt"}
    one = rows["The Experience #1 - Ann Lee.txt"]
    assert one.episode_id == "JRE-1" and one.sentences[:3] == ["Hello there.", "This is one.", "Two lines?"]
    assert "�" in rows["Odd & bad.txt"].raw_text
    assert found.where("name like 'Odd%'").select(files.decoded(F.col("content"), "ignore")).first()[0] == "bad  bytes"
    assert ingest.bronze(found).schema.fieldNames() == schemas.BRONZE.fieldNames()
    seen = ingest.audit(found)
    assert tuple(ingest.audit_summary(seen).first()) == (2, 1, 1)
    lines = [r.value for r in ingest.audit_report(seen).collect()]
    assert lines == ["files: 2", "too small: 1", "unreadable: 1", "small: Odd & bad.txt (12 bytes)", "Odd & bad.txt", "The Experience #1 - Ann Lee.txt"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"é{i}", "a" if i % 2 else "b") for i in range(10)], "id int, t string, type string")
    sinks.parquet(df, str(tmp_path / "p"), rows_per_file=3, by=["type"])
    assert files.table(spark, str(tmp_path / "p")).count() == 10 and len(list(tmp_path.glob("p/type=a/*.parquet"))) >= 2
    assert "PartitionFilters: [isnotnull(type" in files.table(spark, str(tmp_path / "p")).where("type = 'a'")._jdf.queryExecution().toString()
    sinks.merged(df, str(tmp_path / "one"))
    assert len(list(tmp_path.glob("one/*.parquet"))) == 1
    sinks.csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 10
    sinks.jsonl(df.select("id", "t"), str(tmp_path / "j"))
    assert sorted(json.loads(x)["t"] for f in tmp_path.glob("j/part*") for x in f.read_text().splitlines())[0] == "é0"
    sinks.lines(df.select("t"), str(tmp_path / "l"))
    assert sinks.head(df.orderBy("id"), 1) == "| id | t | type |\n| --- | --- | --- |\n| 0 | é0 | b |"
    assert sinks.unique(df, "id") and not sinks.unique(df, "type")
    sinks.vectors(spark.createDataFrame([(1, [1.0])], "id int, embeddings array<float>"), "vecs", "embeddings")
    sinks.vectors(spark.createDataFrame([(2, [1.0])], "id int, embeddings array<float>"), "vecs", "embeddings")
    assert [tuple(r) for r in spark.table("vecs").collect()] == [(2, [1.0])]
    sinks.vectors(spark.createDataFrame([([3.0], 3)], "embeddings array<float>, id int"), "vecs", "embeddings", append=True)
    assert sorted(r.id for r in spark.table("vecs").collect()) == [2, 3] and not [t.name for t in spark.catalog.listTables() if t.name.startswith("vecs_")]
    for name, n in (("b", 1), ("a", 2)):
        df.limit(1).selectExpr("id", f"{n} AS n").coalesce(1).write.parquet(str(tmp_path / "parts" / name))
    parts = files.ordered_parts(spark.read.parquet(str(tmp_path / "parts" / "a"), str(tmp_path / "parts" / "b")))
    assert [(r.id, r.n) for r in files.last_by_part(parts, "id").collect()] == [(df.first().id, 1)]
    files.required(spark, str(tmp_path / "p"))
    with pytest.raises(FileNotFoundError, match="nowhere"):
        files.required(spark, str(tmp_path / "p"), str(tmp_path / "nowhere"))
    assert files.ordered_parts(files.table(spark, str(tmp_path / "p"))).select("part").distinct().count() > 2


def test_rows_are_sent_in_batches(spark, tmp_path):
    folder = str(tmp_path)

    def send(rows):
        with open(f"{folder}/{rows[0]['id']}", "w") as f:
            f.write(" ".join(str(r["id"]) for r in rows))

    sinks.in_batches(spark.range(25).repartition(3), 4, send)
    sent = [f.read_text().split() for f in tmp_path.iterdir()]
    assert sorted(int(x) for b in sent for x in b) == list(range(25)) and max(map(len, sent)) == 4


def test_prompts_traces_and_schemas(spark, tmp_path):
    (tmp_path / "golden.json").write_text(json.dumps([{"category": "a", "query": "b"}, {"category": "c", "query": "d"}], indent=1))
    assert files.prompts(spark, str(tmp_path / "golden.json")).count() == 2 == files.literal_prompts(spark, [("a", "b"), ("c", "d")]).count()
    built_in = files.literal_prompts(spark, PROMPTS)
    assert {r.category: r["count"] for r in built_in.groupBy("category").count().collect()} == {"Deep Cut": 6, "Graph Logic": 5, "Ambiguous": 4, "Adversarial": 4, "Synthesis": 5}
    traces = spark.range(40).select(F.col("id").alias("trace_id"), (F.col("id") % 2 == 0).alias("is_root"), F.timestamp_seconds("id").alias("start_time"))
    got = [r.trace_id for r in files.recent_traces(traces, 3).collect()]
    assert got == [38, 36, 34]
    nodes, edges = spark.createDataFrame([("a", "PERSON")], schemas.NODES), spark.createDataFrame([("a", "b", "DISCUSSED", "c", True, 1.0)], schemas.EDGES)
    assert {tuple(r) for r in files.graph_schema(nodes, edges).collect()} == {("label", "PERSON"), ("relationship", "DISCUSSED")}
    assert files.vector_column(spark.createDataFrame([([1], [2.0])], "tags array<int>, vector array<float>").schema) == "vector"
    assert files.vector_column(spark.createDataFrame([([1], 2)], "tags array<int>, b int").schema) == "tags"
    assert files.vector_column(spark.range(1).schema) is None


def test_settings():
    found = files.settings('a:\n  b: "x"  # note\n  n: 20\nads:\n  known:\n    - "p q"\n    - r\n  more:\n    - 1\nlast: true\n')
    assert found == {"a": {"b": "x", "n": 20}, "ads": {"known": ["p q", "r"], "more": [1]}, "last": True}
    assert files.settings('{"a": 1}') == {"a": 1}


def test_stream_ingests_each_file_once(spark, folder):
    out, mark = str(folder / "bronze"), str(folder / "mark")
    stream.stream_bronze(spark, str(folder / "raw"), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    (folder / "raw" / "MMA Show #2 with Cy.txt").write_text("More. " * 200)
    stream.stream_bronze(spark, str(folder / "raw"), out, mark).awaitTermination()
    assert sorted(r.episode_id for r in spark.read.parquet(out).collect()) == ["JRE-1", "MMA-2", "Special-Odd___bad"]


def test_streamed_counts_equal_the_batch(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("episode_id"), F.col("text").alias("raw_text"))
    for k in range(3):
        docs.where(F.pmod(F.xxhash64("episode_id"), F.lit(3)) == k).write.mode("append").parquet(str(tmp_path / "docs"))
    live = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "docs"))
    p = Params()
    stream.stream_phrase_counts(live, str(tmp_path / "out"), str(tmp_path / "mark"), p).awaitTermination()
    got = {tuple(r) for r in stream.phrase_counts(spark, str(tmp_path / "out"), p).collect()}
    assert got and got == {tuple(r) for r in phrase_frequency(docs, p).collect()}


def test_watermarked_windows(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "e"))
    live = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = stream.windowed_events(live).writeStream.format("memory").queryName("by_day").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("by_day").agg(F.sum("n")).first()[0] == events.count() == stream.windowed_events(events).agg(F.sum("n")).first()[0]


def test_corpora_as_json_lines(spark, tmp_path):
    rows = [("a-0000", "a", "w" * 60, 0.4, False, "Business"), ("a-0001", "a", "short", 0.4, False, "Business"), ("a-0002", "a", "v" * 60, 0.4, True, "Business")]
    table = spark.createDataFrame(rows, "chunk_id string, episode_id string, text_content string, host_probability double, has_visual_context boolean, stage string")
    sinks.jsonl(chunk.host_corpus(table, Params()), str(tmp_path / "host"))
    lines = [json.loads(x) for f in tmp_path.glob("host/part*") for x in f.read_text().splitlines()]
    assert lines == [{"text": "w" * 60, "meta": {"chunk_id": "a-0000", "episode_id": "a", "stage": "Business", "score": 0.4}}]
    assert [r.meta.chunk_id for r in chunk.visual_corpus(table).collect()] == ["a-0002"]


def test_session_settings(spark):
    assert session(spark__sql__shuffle__partitions=4).conf.get("spark.sql.adaptive.enabled") == "true"
