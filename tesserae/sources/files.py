"""Sources and sinks: directories of evidence, pages, and Parquet export and import of modules."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ingest import media_type
from ..functions.text import mapped


def directory(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True, hidden: bool = False, most_bytes: int | None = None) -> DataFrame:
    """(origin, title, size, media_type, data, digest) of the files under a directory, in any order; hidden files and those in
    hidden folders are left out unless asked for, larger files are refused. Links aren't followed out of the directory: a file
    whose real path lies elsewhere is refused, where the directory is a local one."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)
    title = F.element_at(F.split("path", "/"), -1)
    rows = found.where(~F.col("path").rlike(r"/\.[^/]+(/|$)")) if not hidden else found
    local = path[7:] if path.startswith("file://") else path
    if "://" not in local and (base := os.path.realpath(local)) and os.path.isdir(base):
        kept = lambda p: (real := os.path.realpath(p.split(":", 1)[1])).startswith(base + os.sep) and not os.path.islink(p.split(":", 1)[1].replace("//", "/"))  # noqa: E731, F841
        rows = rows.where(mapped(kept, "boolean")("path"))
    rows = rows if most_bytes is None else rows.where(F.col("length") <= most_bytes)
    return rows.select(F.col("path").alias("origin"), title.alias("title"), F.col("length").alias("size"), media_type(F.col("path")).alias("media_type"), F.col("content").alias("data"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"))


def export(df: DataFrame, path: str, partition: str | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def load(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def clean_origin(url):
    """An address without its fragment and tracking parameters, in lower case: the key by which pulls tell origins apart."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "#.*$", ""), "(?<=[?&])utm_[a-z]+=[^&]*&?", "")
    return F.regexp_replace(bare, "[?&]+$", "")


def origins(records: DataFrame) -> DataFrame:
    """(block_id, origin): where each canonical block came from, by its latest registration record (block_id, origin, at)."""
    rows = records.where(F.col("origin").isNotNull())
    return rows.groupBy("block_id").agg(F.max(F.struct("at", "origin")).alias("m")).select("block_id", "m.origin")


def content(blobs: DataFrame, digests: DataFrame) -> DataFrame:
    """(digest, data) of the digests asked for; tombstoned bytes are null."""
    return blobs.join(digests.select("digest").distinct(), "digest", "left_semi").select("digest", "data")
