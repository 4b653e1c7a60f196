"""Tables as blocks of the five memory types, with their projections: what ``IndexSet.build`` takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import projection

STRINGS = "array<string>"


def _stored(content: Column, subject: Column | None = None, tags: Column | None = None, occurred_at: Column | None = None, evidence: Column | None = None) -> list[Column]:
    null = lambda c, kind: F.lit(None).cast(kind) if c is None else c.cast(kind)
    return [
        null(subject, "string").alias("subject"), null(tags, STRINGS).alias("tags"), null(occurred_at, "string").alias("occurred_at"),
        null(evidence, STRINGS).alias("evidence"), content.alias("content"), F.concat(F.lit("sha256:"), F.sha2(content, 256)).alias("digest"),
    ]


def blocks(rows: DataFrame, memory_type: str, content: Column, subject: Column | None = None, tags: Column | None = None, occurred_at: Column | None = None, evidence: Column | None = None) -> DataFrame:
    """The stored form of blocks (block_id, ...): fields that filters ask about, and the content with its digest."""
    return rows.select(F.lit(memory_type).alias("memory_type"), "block_id", *_stored(content, subject, tags, occurred_at, evidence))


def whole(rows: DataFrame, memory_type: str, content: Column, **fields: Column) -> DataFrame:
    """The projection of rows with their stored form beside it (``stored``), so that the two needn't be joined."""
    return projection.project(typed(rows.withColumn("stored", F.struct(*_stored(content, **fields))), memory_type, "stored"), memory_type, "stored")


def typed(rows: DataFrame, memory_type: str, *kept: str) -> DataFrame:
    """``rows`` with every column of the type's schema, null where they lack it, and those named in ``kept``."""
    have = set(rows.columns)
    return rows.select(*kept, *[F.col(f.name).cast(f.dataType) if f.name in have and f.name != "block_id" else F.col("block_id") if f.name == "block_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in projection.SCHEMAS[memory_type]])


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("block_id"), F.col("text").alias("statement"), F.col("source").alias("subject"), F.array("lang").alias("evidence"))


def whole_documents(docs: DataFrame) -> DataFrame:
    return whole(_documents(docs), "semantic", F.col("statement"), subject=F.col("subject"), evidence=F.col("evidence"))


def documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents as semantic blocks: the text is the statement, the source the subject, the language its evidence."""
    rows = _documents(docs)
    return projection.project(typed(rows, "semantic"), "semantic"), blocks(rows, "semantic", F.col("statement"), F.col("subject"), evidence=F.col("evidence"))


def _events(table: DataFrame) -> DataFrame:
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    summary = F.concat_ws(" ", "event_type", F.lit("by user"), F.col("user_id").cast("string"))
    return table.select(F.col("event_id").alias("block_id"), summary.alias("summary"), at.alias("occurred_at"), F.col("props").alias("context"), F.array("event_type").alias("tags"), F.array(F.concat(F.lit("user "), F.col("user_id").cast("string"))).alias("participants"))


def whole_events(table: DataFrame) -> DataFrame:
    return whole(_events(table), "episodic", F.concat_ws("\n", "summary", "context"), tags=F.col("tags"), occurred_at=F.col("occurred_at"))


def events(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events as episodic blocks: type and properties in words, the type as tag, the user as participant."""
    rows = _events(table)
    return projection.project(typed(rows, "episodic"), "episodic"), blocks(rows, "episodic", F.concat_ws("\n", "summary", "context"), tags=F.col("tags"), occurred_at=F.col("occurred_at"))
