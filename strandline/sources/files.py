"""Readers: raw text files, tables, prompts, configuration."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

VECTOR_NAMES = ("embedding", "embeddings", "vector", "vectors", "values")


def text_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """``path, name, length, content`` of the files of a folder, not of those below it."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("name"), "length", "content")


def decoded(content: Column, errors: str = "replace") -> Column:
    """UTF-8 text of bytes; invalid bytes are replaced by U+FFFD or dropped."""
    text = F.make_valid_utf8(content.cast("string"))
    return text if errors == "replace" else F.replace(text, F.lit("�"), F.lit(""))


def table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet file or folder; with a schema no file is opened to plan."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def ordered_parts(df: DataFrame) -> DataFrame:
    """With ``part``, the file of each row, for what depends on the order of files."""
    return df.withColumn("part", F.input_file_name())


def last_by_part(df: DataFrame, *keys: str) -> DataFrame:
    """Of the rows of a key the one from the last file by name; of several there the greatest."""
    row = F.struct("part", *(c for c in df.columns if c not in ("part", *keys)))
    last = df.groupBy(*keys).agg(F.max(row).alias("last"))
    return last.select(*(c if c in keys else F.col("last")[c].alias(c) for c in df.columns))


def required(spark: SparkSession, *paths: str) -> None:
    """A plain error that names the inputs that a stage lacks, before it starts."""
    jvm = spark._jvm.org.apache.hadoop.fs
    missing = [p for p in paths if not (path := jvm.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)]
    if missing:
        raise FileNotFoundError("missing: " + ", ".join(missing))


def prompts(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of ``category`` and ``query``."""
    return spark.read.schema(schemas.PROMPTS).option("multiLine", True).json(path)


def literal_prompts(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, schemas.PROMPTS)


def recent_traces(traces: DataFrame, n: int = 20) -> DataFrame:
    """The latest root runs."""
    return traces.where("is_root").orderBy(F.desc("start_time"), "trace_id").limit(n)


def graph_schema(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``kind, name``: node labels and relationship types."""
    label = nodes.select(F.lit("label").alias("kind"), F.col("type").alias("name"))
    return label.union(edges.select(F.lit("relationship").alias("kind"), F.col("type").alias("name"))).distinct()


def vector_column(schema: T.StructType) -> str | None:
    """The vector column: by name, else the first array."""
    names = {f.name for f in schema.fields}
    for n in VECTOR_NAMES:
        if n in names:
            return n
    return next((f.name for f in schema.fields if isinstance(f.dataType, T.ArrayType)), None)


def settings(text: str) -> dict:
    """Configuration from JSON, or from YAML of nested keys, strings and lists; a YAML library is used if there is one."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    try:
        import yaml

        return yaml.safe_load(text)
    except ImportError:
        pass
    root: dict = {}
    stack: list[tuple[int, dict | list, str | None, dict | None]] = [(-1, root, None, None)]
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", raw).rstrip()
        if not line:
            continue
        indent, body = len(line) - len(line.lstrip()), line.strip()
        while stack[-1][0] >= indent and len(stack) > 1 and not (body.startswith("- ") and isinstance(stack[-1][1], list) and stack[-1][0] <= indent):
            stack.pop()
        holder = stack[-1]
        if body.startswith("- "):
            if isinstance(holder[1], dict) and not holder[1] and holder[3] is not None:
                items: list = []
                holder[3][holder[2]] = items
                stack[-1] = (holder[0], items, holder[2], holder[3])
                holder = stack[-1]
            holder[1].append(_scalar(body[2:]))
            continue
        key, _, value = body.partition(":")
        if value.strip():
            holder[1][key.strip()] = _scalar(value)
        else:
            child: dict = {}
            holder[1][key.strip()] = child
            stack.append((indent, child, key.strip(), holder[1]))
    return root


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1]:
        return text[1:-1]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None}.get(text.lower(), text)
