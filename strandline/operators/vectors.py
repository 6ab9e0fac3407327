"""Vector table and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring as s
from ..functions.providers import Expression, hashed_embedding
from ..sources.files import vector_column
from . import nearest as pruned


def embedded(chunks: DataFrame, embed: Expression | None = None, *, text: str = "text_content") -> DataFrame:
    """``chunks`` with ``vector``, of length 1."""
    return chunks.withColumn("vector", s.normalised((embed or hashed_embedding())(F.col(text))))


def vector_table(df: DataFrame) -> DataFrame:
    """``df`` with its vector column named ``vector``, normalised."""
    name = vector_column(df.schema)
    if name is None:
        raise ValueError("no vector column")
    return df.withColumn(name, s.normalised(F.col(name))).withColumnRenamed(name, "vector")


def nearest(table: DataFrame, query: list[float], k: int = 3, *, key: str = "chunk_id") -> DataFrame:
    """The ``k`` rows nearest to one vector, with ``distance`` (squared): a scan and a heap of ``k`` in each task."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return table.withColumn("distance", s.squared_distance(F.col("vector"), q)).orderBy("distance", key).limit(k)


def nearest_each(table: DataFrame, queries: DataFrame, k: int = 3, **how) -> DataFrame:
    """``query_id, rank, key, distance``: the ``k`` nearest rows of each query of ``query_id, query``; see ``nearest.nearest_each``."""
    return pruned.nearest_each(table, queries, k, **how).rows


def embedded_in_batches(chunks: DataFrame, encode: Callable[[list[str]], np.ndarray], *, text: str = "text_content", batch: int = 128) -> DataFrame:
    """``chunks`` with ``vector``, of length 1, from a model: ``encode`` gets at most ``batch`` texts and gives a row for each.

    It is called in the tasks; a null text is an empty one.
    """
    schema = T.StructType([*chunks.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                got = np.asarray(encode([x or "" for x in part.column(part.schema.get_field_index(text)).to_pylist()]), np.float64)
                length = np.linalg.norm(got, axis=1, keepdims=True)
                got = np.where(length > 0, got / np.where(length > 0, length, 1), got).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(got), pa.list_(pa.float32()))], names=[*part.schema.names, "vector"])

    return chunks.mapInArrow(run, schema)


def label_agreement(hits: DataFrame, labels: DataFrame, *, key: str = "vec_id", label: str = "label") -> DataFrame:
    """``label, queries, agreement``: how often neighbours share the query's label."""
    of = lambda k, name: labels.select(F.col(key).alias(k), F.col(label).alias(name))
    both = hits.join(of("query_id", "label"), "query_id").join(of(key, "found"), key)
    same = F.avg((F.col("label") == F.col("found")).cast("int"))
    return both.groupBy("label").agg(F.countDistinct("query_id").alias("queries"), s.round2(100 * same).alias("agreement"))


def centroids(table: DataFrame, *, group: str = "label") -> DataFrame:
    """``query_id, query``: the mean vector of each group. Partial sums keep one row for a place, group and task."""
    each = table.select(group, F.posexplode("vector").alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s_: s_["x"])
    return each.groupBy(F.col(group).alias("query_id")).agg(listed.alias("query"))
