"""Raw files to bronze: audit, metadata from file names, sentence split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..params import Params
from ..sources.files import decoded

# The ids of episodes depend on these three patterns.
_PART = r"(?i)\(Part\s*(\d+|One|Two|Three)\)"
_MAIN = r"(?i)Experience\s*#(\d+)\s*-\s*(.*)"
_FIGHT = r"(?i)MMA Show\s*#(\d+)\s*(?:-\s*with\s*|-\s*|with\s*)(.*)"


def file_metadata(name: Column) -> Column:
    """``episode_id, show_type, guest_draft`` of a file name: the main show, the fight show, or a special."""
    bare = t.strip(F.replace(name, F.lit(".txt"), F.lit("")))
    part = F.lower(F.regexp_extract(bare, _PART, 1))
    number = F.when(part == "one", "1").when(part == "two", "2").when(part == "three", "3").otherwise(part)
    suffix = F.when(part == "", "").otherwise(F.concat(F.lit("-"), number))
    show = lambda tag, p: F.struct(F.concat(F.lit(f"{tag}-"), F.regexp_extract(bare, p, 1), suffix).alias("episode_id"), F.lit(tag).alias("show_type"), t.strip(F.regexp_extract(bare, p, 2)).alias("guest_draft"))
    other = F.struct(F.concat(F.lit("Special-"), F.regexp_replace(bare, "[^a-zA-Z0-9]", "_")).alias("episode_id"), F.lit("Special").alias("show_type"), F.lit("Unknown").alias("guest_draft"))
    return F.when(bare.rlike(_MAIN), show("JRE", _MAIN)).when(bare.rlike(_FIGHT), show("MMA", _FIGHT)).otherwise(other)


def bronze(files: DataFrame, p: Params = Params()) -> DataFrame:
    """One row for each file of ``name, content``."""
    named = files.select(F.col("name").alias("original_filename"), file_metadata(F.col("name")).alias("m"), decoded(F.col("content")).alias("raw_text"))
    pieces = F.transform(p.split(F.col("raw_text")), t.strip)
    return named.select("m.episode_id", "original_filename", "m.show_type", "m.guest_draft", "raw_text", pieces.alias("sentences"))


def from_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", guest: str = "source") -> DataFrame:
    """Documents of a table as bronze rows; the sentence list is made where it is used."""
    return docs.select(docs[key].cast("string").alias("episode_id"), docs[guest].alias("guest_draft"), docs[text].alias("raw_text"))


def audit(files: DataFrame, least: int = 500) -> DataFrame:
    """``name, length, too_small, valid_utf8`` of each file of ``name, length, content``."""
    return files.select("name", "length", (F.col("length") < least).alias("too_small"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid_utf8"))


def audit_summary(audited: DataFrame) -> DataFrame:
    """One row: files, files that are too small, files that aren't UTF-8."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return audited.agg(F.count(F.lit(1)).alias("files"), n(F.col("too_small")).alias("too_small"), n(~F.col("valid_utf8")).alias("unreadable"))


def audit_report(audited: DataFrame) -> DataFrame:
    """The lines of a text report: totals, suspicious files, all names in order."""
    total = audit_summary(audited).select(F.array(F.format_string("files: %d", "files"), F.format_string("too small: %d", "too_small"), F.format_string("unreadable: %d", "unreadable")).alias("x"))
    head = total.select(F.posexplode("x")).select(F.lit(0).alias("block"), F.format_string("%05d", "pos").alias("at"), F.col("col").alias("value"))
    small = audited.where("too_small").select(F.lit(1).alias("block"), F.col("name").alias("at"), F.format_string("small: %s (%d bytes)", "name", "length").alias("value"))
    names = audited.select(F.lit(2).alias("block"), F.col("name").alias("at"), F.col("name").alias("value"))
    return head.union(small).union(names).orderBy("block", "at").select("value")
