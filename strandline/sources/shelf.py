"""Tables written between the steps of a job.

Executors come and go, so lineage is cut by writing Parquet to the folder that
the cluster shares (``spark.checkpoint.dir``), never by a local checkpoint.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Only where all runs on one machine may the session name none; a private one is set then."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Shelf:
    """Named tables of one job under the shared folder."""

    def __init__(self, spark: SparkSession, job: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"
        self.written = 0

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as read from the file."""
        self.written += 1
        path = f"{self.root}/{self.written:04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.shelf_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        remove(self.spark, df.shelf_path)


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder in whatever store the path names."""
    found, store = _path(spark, path)
    return store.exists(found)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all in it, if it is there."""
    found, store = _path(spark, path)
    store.delete(found, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores until no column of ``df`` has that name, in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores if it is read by fewer tasks than there are cores.

    A small file of one row group is one task, and features of texts are much work for each byte. Large inputs have more
    tasks than cores and aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
