"""Evidence in: pulls from sources, and the run from registration over proposals to the commit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ingest as normal
from ..operators import lifecycle, scratch, stats
from ..sources import files

OUTCOMES = ("registered", "duplicate", "skipped", "failed", "would-fetch", "not-reached")
#: Kinds of source by name: each takes (spark, options) and gives (origin, title, size, media_type, data, digest).
SOURCES: dict[str, Callable[..., DataFrame]] = {"directory": lambda spark, **o: files.directory(spark, **o), "parquet": lambda spark, path: spark.read.parquet(path)}
#: Proposers by name: each takes blocks (doc_id, text) and gives candidates.
PROPOSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"structure": normal.proposals}


def register_source(name: str, make: Callable[..., DataFrame]) -> None:
    """A kind of source of one's own; it replaces a built-in of the same name."""
    SOURCES[name] = make


def pull(items: DataFrame, registered: DataFrame, tombstones: DataFrame, limit: int | None = None, dry_run: bool = False, refetch: bool = False) -> DataFrame:
    """``items`` with an outcome, in order of origin. Items: (origin, media_type, digest, ...; a null digest couldn't be read);
    registered: (origin, media_type, digest); tombstones: (digest).

    A known origin of the same media type is skipped, unless ``refetch``; a dry run would fetch the rest. What can't be read has
    failed, redacted bytes are skipped, known content is a duplicate, and of equal contents in one pull the first registers. With
    ``limit`` items behind the last registration that it allows aren't reached."""
    known = registered.groupBy(F.col("origin").alias("o")).agg(F.collect_set("media_type").alias("types"))
    same = registered.select(F.col("digest").alias("d")).distinct()
    gone = tombstones.select(F.col("digest").alias("t")).distinct()
    rows = items.join(known, F.col("origin") == F.col("o"), "left").join(same, F.col("digest") == F.col("d"), "left").join(gone, F.col("digest") == F.col("t"), "left")
    held = F.col("o").isNotNull() & F.coalesce(F.array_contains("types", F.col("media_type")), F.lit(False))
    state = F.when(held & F.lit(not refetch), "skipped").when(F.lit(dry_run), "would-fetch").when(F.col("digest").isNull(), "failed")
    state = state.when(F.col("t").isNotNull(), "skipped").when(F.col("d").isNotNull(), "duplicate").otherwise("registered")
    rows = rows.withColumn("outcome", state).drop("o", "types", "d", "t")
    first = rows.where("outcome = 'registered'").groupBy(F.col("digest").alias("fd")).agg(F.min("origin").alias("fo"))
    rows = rows.join(first, F.col("digest") == F.col("fd"), "left")
    rows = rows.withColumn("outcome", F.when((F.col("outcome") == "registered") & (F.col("origin") != F.col("fo")), "duplicate").otherwise(F.col("outcome"))).drop("fd", "fo")
    if limit is None or dry_run:
        return rows
    last = stats.numbered(rows.where("outcome = 'registered'").select("origin"), ["origin"]).where(F.col("r") == limit - 1).select(F.col("origin").alias("last"))
    rows = rows.join(F.broadcast(last), how="left") if limit > 0 else rows.withColumn("last", F.lit(""))  # one row at most
    return rows.withColumn("outcome", F.when(F.col("origin") > F.col("last"), "not-reached").otherwise(F.col("outcome"))).drop("last")


def pull_all(pulls: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """(outcomes of every source, {source: error}): one that fails doesn't stop the others."""
    out, errors = None, {}
    for name, make in sorted(pulls.items()):
        try:
            rows = make().withColumn("source", F.lit(name))
            rows.limit(1).count()  # a source is read here, so its error is its own
        except Exception as e:  # noqa: BLE001  whatever a source raises is reported with its name
            errors[name] = str(e).splitlines()[0] if str(e) else type(e).__name__
            continue
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, errors


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def canonical(items: DataFrame, normalize: bool = True) -> DataFrame:
    """Registered items as canonical blocks: (block_id, media_type, size, view_text, origin); the view is the pipeline's text."""
    text = F.when(F.col("data").isNotNull(), F.col("data").cast("string"))
    view = normal.normalized_view(F.col("media_type"), text) if normalize else F.lit(None).cast("string")
    return items.select(F.col("digest").alias("block_id"), "media_type", F.octet_length("data").alias("size"), view.alias("view_text"), "origin")


def replace(held: DataFrame, old, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks with the new one added, supersession (block_id, superseded_by)): the old block stays a member."""
    fresh = lifecycle.register(new, held)
    record = new.select(F.lit(old).alias("block_id"), F.col("block_id").alias("superseded_by"))
    return held.unionByName(fresh, allowMissingColumns=True), record.where(F.col("block_id") != F.col("superseded_by"))


@dataclass(frozen=True)
class Task:
    """What a proposer is asked for."""

    source: str
    memory_types: tuple[str, ...] = ("semantic",)
    proposer: str = "structure"
    threshold: float = 0.5


CANDIDATE_SCHEMA = {
    "type": "object", "required": ["kind", "label", "statement", "evidence", "confidence"],
    "properties": {k: {"type": "array" if k == "evidence" else "string"} for k in ("kind", "label", "statement", "evidence", "confidence", "locator")},
}


@dataclass
class Run:
    registered: DataFrame
    candidates: DataFrame
    committed: DataFrame
    counts: dict[str, int]


def identified(candidates: DataFrame) -> DataFrame:
    """With the block id: the digest of the fields that make a block, in order of name; confidence and place aren't of it."""
    body = F.to_json(F.struct(*[F.col(c) for c in sorted(("kind", "label", "statement", "evidence"))]))
    return candidates.withColumn("block_id", F.concat(F.lit("sha256:"), F.sha2(body, 256)))


def run(spark: SparkSession, items: DataFrame, held: DataFrame, knowledge: DataFrame, task: Task, dry_run: bool = False) -> Run:
    """Register, propose over the normalized views, validate, commit. ``held``: canonical blocks; ``knowledge``: (block_id, label,
    statement) that stand already. All or nothing: one blocked candidate holds all back; a dry run commits none."""
    blocks = canonical(items)
    fresh = lifecycle.register(blocks, held)
    views = blocks.where(F.col("view_text").isNotNull()).select(F.col("block_id").alias("doc_id"), F.col("view_text").alias("text")).dropDuplicates(["doc_id"])
    made = identified(PROPOSERS[task.proposer](views))
    judged = lifecycle.validation(made, knowledge, "block_id", "evidence", task.threshold)
    judged = scratch.saved(lifecycle.contradicted(judged, knowledge), "candidates")  # counted, looked through for blocked ones and committed
    committed = lifecycle.commit(judged).limit(0) if dry_run else lifecycle.commit(judged)
    counts = {r.status: r["count"] for r in judged.groupBy("status").count().collect()}  # one row a status
    return Run(fresh, judged, committed, counts | {"already_held": counts.get("duplicate", 0)})
