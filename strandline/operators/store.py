"""A stored graph that batches of nodes and edges are merged into, and a substring index of its names.

A table of the store has one row for each key and lies in buckets by hash of the key.
A merge reads the buckets that its rows fall into, folds old and new rows, and writes
these buckets anew; all others keep their files. What is folded (the greatest chunk,
sums) doesn't depend on the order of batches, and a batch that was merged before is
left out, so a job that runs again does no harm. The new buckets are written beside the
store first: a merge that was cut off while they were put in place is finished by the
next one. One writer at a time; a reader sees a bucket as it was or as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.sizes import sent_if_small
from ..sources.shelf import exists, remove

_TEXT = T.StringType()


def _tables() -> dict[str, tuple[tuple[str, ...], list[Column]]]:
    """Each table: its keys, and the folds of its other columns."""
    last = F.max(F.struct("chunk_id", "chaos"))
    edge = [last["chunk_id"].alias("chunk_id"), last["chaos"].alias("chaos"), F.sum("mentions").alias("mentions"), F.sum("weight").alias("weight")]
    return {"nodes": (("type", "id"), []), "edges": (("source", "target", "type"), edge)}


def _schema(table: str) -> T.StructType:
    field = lambda *names: [T.StructField(n, _TEXT) for n in names]
    rest = {"nodes": field("type", "id"), "edges": [*field("source", "target", "type", "chunk_id"), T.StructField("chaos", T.BooleanType()), T.StructField("mentions", T.LongType()), T.StructField("weight", T.DoubleType())]}
    return T.StructType([*rest[table], T.StructField("bucket", T.IntegerType())])


class GraphStore:
    """Nodes ``type, id`` and edges ``source, target, type, chunk_id, chaos, mentions, weight`` under a folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        """Open the store at ``root``, or begin one; the number of buckets is that of its first opening."""
        self.spark, self.root = spark, root.rstrip("/")
        if not exists(spark, f"{self.root}/settings"):
            spark.createDataFrame([(buckets,)], "buckets int").write.mode("overwrite").parquet(f"{self.root}/settings")
        self.buckets = spark.read.parquet(f"{self.root}/settings").first().buckets

    def _read(self, table: str, root: str | None = None) -> DataFrame:
        path = f"{root or self.root}/{table}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], _schema(table))
        return self.spark.read.schema(_schema(table)).parquet(path)

    def _bucketed(self, df: DataFrame, table: str) -> DataFrame:
        keys = _tables()[table][0]
        return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int"))

    def batches(self) -> list[str]:
        """The names of the batches in the store."""
        path = f"{self.root}/batches"
        return sorted(r.batch for r in self.spark.read.parquet(path).distinct().collect()) if exists(self.spark, path) else []

    def merge(self, batch: str, *, nodes: DataFrame, edges: DataFrame) -> bool:
        """Fold a batch into the store; false if it is in it.

        Rows of a batch may repeat keys: nodes count once, edges are summed. Rows with a null key are dropped. An edge may
        come before its nodes: it is kept, and seen by ``edges`` once both are there.
        """
        self.finish()
        if exists(self.spark, f"{self.root}/batches") and self.spark.read.parquet(f"{self.root}/batches").where(F.col("batch") == batch).limit(1).count():
            return False
        remove(self.spark, self._staged)
        for table, new in (("nodes", nodes), ("edges", edges)):
            keys, folds = _tables()[table]
            columns = [c for c in _schema(table).names if c != "bucket"]
            new = self._bucketed(new.select(*columns).dropna(subset=list(keys)), table)
            touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
            both = self._read(table).where(F.col("bucket").isin(touched)).select(*new.columns).union(new)
            folded = both.groupBy("bucket", *keys).agg(*folds) if folds else both.dropDuplicates(["bucket", *keys])
            self._write(folded.hint("rebalance", F.col("bucket")), f"{self._staged}/{table}")
        self.spark.createDataFrame([(batch,)], "batch string").write.parquet(f"{self._staged}/batches")
        self.finish()
        return True

    @property
    def _staged(self) -> str:
        return f"{self.root}/_staged"

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("bucket").parquet(path)

    def finish(self) -> None:
        """Put buckets in place that a merge had ready; buckets of one that was cut off before that are dropped by the next."""
        if not exists(self.spark, f"{self._staged}/batches/_SUCCESS"):
            return
        for table in _tables():
            self._write(self._read(table, self._staged).hint("rebalance", F.col("bucket")), f"{self.root}/{table}")
        self.spark.read.parquet(f"{self._staged}/batches").write.mode("append").parquet(f"{self.root}/batches")
        remove(self.spark, self._staged)

    def nodes(self) -> DataFrame:
        return self._read("nodes").drop("bucket")

    def edges(self) -> DataFrame:
        """The edges both of whose ends are nodes of the right type."""
        found, nodes = self._read("edges").drop("bucket"), self.nodes()
        for end, kind in (("source", F.when(F.col("type") == "DISCUSSED", "PERSON").otherwise("CONCEPT")), ("target", F.lit("CONCEPT"))):
            names = nodes.select(F.col("id").alias(end), F.col("type").alias("kind"))
            found = found.withColumn("kind", kind).join(sent_if_small(names), [end, "kind"], "left_semi").drop("kind")
        return found.select("source", "target", "type", "chunk_id", "chaos", "mentions", "weight")


#: Names found that become a filter of the scan; more are joined.
MOST_NAMES = 10_000


def grams(name: Column, n: int = 3) -> Column:
    """The distinct runs of ``n`` characters of a name, lower-cased."""
    low = F.lower(name)
    starts = F.when(F.length(low) >= n, F.sequence(F.lit(1), F.length(low) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(low, i, F.lit(n))))


class NameIndex:
    """Neighbours of all names that contain a text, without a scan of the edges.

    ``postings`` has a row for each three characters in a row and name, in order of the former; ``links`` has the edges in
    both directions, in order of the name. A text is looked up by its own characters: names that have all of them
    are few, and are compared. Both tables are sorted over their files, so a scan with a filter reads the row groups
    that the filter can meet.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, edges: DataFrame) -> NameIndex:
        """Write the index of the DISCUSSED edges ``source, target, type, chunk_id``; one that is there is replaced."""
        own = edges.where(F.col("type") == "DISCUSSED")
        side = lambda a, b: own.select(F.col(a).alias("entity"), F.col("type").alias("rel"), F.col(b).alias("connected_to"), F.col("chunk_id").alias("chunk"))
        links = side("source", "target").union(side("target", "source")).where("entity IS NOT NULL")
        self._sorted(links, "links", "entity", "connected_to", "chunk")
        self._sorted(self.links().select(F.col("entity").alias("name")).distinct(), "names", "name")
        each = self.spark.read.parquet(f"{self.root}/names").select(F.explode(grams(F.col("name"))).alias("gram"), "name")
        self._sorted(each, "postings", "gram", "name")
        return self

    def _sorted(self, df: DataFrame, table: str, *by: str) -> None:
        df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{table}")

    def links(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/links")

    def names(self, text: str) -> DataFrame:
        """``name``: the names that contain the text, whatever the case. A text of fewer than three characters takes a scan of the names."""
        low = text.lower()
        parts = sorted({low[i : i + 3] for i in range(len(low) - 2)})
        if parts:
            own = self.spark.read.parquet(f"{self.root}/postings").where(F.col("gram").isin(parts))
            some = own.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(parts)).select("name")
        else:
            some = self.spark.read.parquet(f"{self.root}/names")
        return some.where(F.contains(F.lower("name"), F.lit(low)))

    def neighbours(self, text: str, n: int | None = 10) -> DataFrame:
        """``entity, rel, connected_to, chunk``: what ``graph.neighbours`` gives. The scan of the links has the names found as its filter."""
        few = [r.name for r in self.names(text).limit(MOST_NAMES + 1).collect()]
        if len(few) <= MOST_NAMES:
            found = self.links().where(F.col("entity").isin(few))
        else:
            found = self.links().join(self.names(text).withColumnRenamed("name", "entity"), "entity", "left_semi")
        found = found.select("entity", "rel", "connected_to", "chunk")
        return found if n is None else found.orderBy("entity", "connected_to", "chunk").limit(n)
