"""Retention and reconciliation: what a removal takes with it, five ways to remove, policies, and two histories made one."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import closure
from .lifecycle import conflicts, reconcile


@dataclass(frozen=True)
class Policy:
    """Modules that may be dropped from, whether evidence itself may be, from how many dependants on a cascade needs review,
    snapshots kept for pruning, and media types whose bytes may be destroyed (none by default)."""

    droppable: frozenset[str] = frozenset({"canonical", "semantic", "procedural", "provenance"})
    canonical: bool = False
    review: int | None = 25
    retained: int = 1
    redactable: frozenset[str] = frozenset()

    def allows(self, memory_type: str) -> bool:
        return memory_type in self.droppable and (self.canonical or memory_type != "canonical")


POLICIES = {"conservative": Policy(), "permissive": Policy(canonical=True, review=None), "archival": Policy(droppable=frozenset(), review=None)}


class Refused(ValueError):
    """The policy or the state forbids the change."""


def policy(profile: str = "conservative", **overrides) -> Policy:
    return replace(POLICIES[profile], **overrides)


def plan_drop(dependencies: DataFrame, members: DataFrame, seeds: DataFrame, rules: Policy = POLICIES["conservative"]) -> tuple[DataFrame, dict]:
    """(ids that would go, {dropped, dependants, needs_review}). ``dependencies``: (src depends on dst); ``members``: (id, ...)."""
    gone = closure(dependencies, seeds).join(members.select("id"), "id", "left_semi")
    dropped = gone.count()
    named = seeds.select("id").distinct().join(members.select("id"), "id", "left_semi").count()
    dependants = dropped - named
    return gone, {"dropped": dropped, "dependants": dependants, "needs_review": rules.review is not None and dependants > rules.review}


def drop(dependencies: DataFrame, members: DataFrame, seeds: DataFrame, memory_type: str, rules: Policy = POLICIES["conservative"], reviewed: bool = False) -> tuple[DataFrame, dict]:
    """(members that stay, what the cascade took), the cascade taken anew. Refused where the policy or a review forbids it."""
    if not rules.allows(memory_type):
        raise Refused(f"{memory_type} may not be dropped from")
    gone, plan = plan_drop(dependencies, members, seeds, rules)
    if plan["needs_review"] and not reviewed:
        raise Refused(f"{plan['dependants']} dependants need review")
    return members.join(gone, "id", "left_anti"), plan


def produced_by(provenance: DataFrame, producer: str, kind: str = "model", version: str | None = None) -> DataFrame:
    """(id): blocks whose provenance names exactly this producer; without a version any version of it."""
    rows = provenance.where((F.col("producer_id") == producer) & (F.col("producer_kind") == kind))
    rows = rows if version is None else rows.where(F.col("producer_version") == version)
    return rows.select(F.col("block_id").alias("id")).distinct()


def drop_by_producer(dependencies: DataFrame, members: DataFrame, provenance: DataFrame, producer: str, kind: str = "model", version: str | None = None, modules: tuple[str, ...] = ("semantic", "procedural", "episodic")) -> DataFrame:
    """Members (id, memory_type) without what one producer derived in these modules and all that depends on it."""
    made = produced_by(provenance, producer, kind, version).join(members.where(F.col("memory_type").isin(list(modules))).select("id"), "id", "left_semi")
    return members.join(closure(dependencies, made), "id", "left_anti")


def supersession(spark, block, superseded, reason: str = "") -> DataFrame:
    """A provenance row: the one takes precedence over the other. Membership stays as it is."""
    return spark.createDataFrame([(superseded, block, "supersede", reason)], f"block_id {_kind(superseded)}, superseded_by {_kind(superseded)}, act string, reason string")


def demotion(spark, block, reason: str = "") -> DataFrame:
    """A provenance row: the block ranks behind its equals."""
    return spark.createDataFrame([(block, None, "demote", reason)], f"block_id {_kind(block)}, superseded_by {_kind(block)}, act string, reason string")


def _kind(value) -> str:
    return "long" if isinstance(value, int) else "string"


def ledger(records: DataFrame) -> DataFrame:
    """(block_id, superseded_by, demoted): what the provenance rows say of accessibility, one row for each block."""
    per = records.groupBy("block_id").agg(F.max("superseded_by").alias("superseded_by"), F.max((F.col("act") == "demote").cast("int")).alias("d"))
    return per.select("block_id", "superseded_by", (F.col("d") == 1).alias("demoted"))


def prune(blobs: DataFrame, snapshots: DataFrame, members: DataFrame, rules: Policy = POLICIES["conservative"]) -> DataFrame:
    """Blobs (digest, ...) that no retained snapshot needs: of ``snapshots`` (snapshot, at) the latest are retained; ``members``:
    (snapshot, digest)."""
    kept = snapshots.orderBy(F.desc("at"), "snapshot").limit(rules.retained)
    return blobs.join(members.join(F.broadcast(kept.select("snapshot")), "snapshot", "left_semi").select("digest").distinct(), "digest", "left_anti")


def redact(blobs: DataFrame, members: DataFrame, block, rules: Policy) -> tuple[DataFrame, DataFrame]:
    """(blobs with the bytes of the block destroyed, tombstones (digest)). Bytes that another member names too stay. Blobs:
    (digest, media_type, data); members: (id, digest). Membership isn't touched."""
    own = members.where(F.col("id") == block).select("digest").distinct()
    shared = members.where(F.col("id") != block).select("digest").distinct()
    named = blobs.join(F.broadcast(own), "digest", "left_semi").select("digest", "media_type")  # one block
    refused = named.where(~F.col("media_type").isin(sorted(rules.redactable))) if rules.redactable else named
    if not refused.isEmpty():
        raise Refused("the policy doesn't allow bytes of this type to be destroyed")
    gone = named.select("digest").join(shared, "digest", "left_anti")
    marked = blobs.join(F.broadcast(gone.withColumn("gone", F.lit(True))), "digest", "left")
    return marked.withColumn("data", F.when(F.col("gone").isNull(), F.col("data"))).drop("gone"), gone


def lineage(strategy: str, base: str, ours: str, theirs: str) -> list[str]:
    """The parents of the snapshot that a strategy lands: merge has both, rebase theirs alone, squash ours alone."""
    return {"merge": [ours, theirs], "rebase": [theirs], "squash": [ours]}[strategy]


@dataclass
class Reconciled:
    """status: done, or halted with the members on which a verdict is missing."""

    status: str
    members: DataFrame
    pending: DataFrame
    parents: list[str]


def land(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, strategy: str = "merge", names: tuple[str, str, str] = ("base", "ours", "theirs"), verdicts: DataFrame | None = None) -> Reconciled:
    """Two histories as one. Additions of both stay. A removal by one side needs a verdict (key, keep): true keeps the member,
    false lets it go; while one is missing the landing halts. All strategies land the same members; only parents differ."""
    removed = conflicts(base, ours, theirs, key)
    said = verdicts if verdicts is not None else removed.select(key, F.lit(True).alias("keep")).limit(0)
    pending = removed.join(said.select(key), key, "left_anti")
    merged = reconcile(base, ours, theirs, key)
    kept = removed.join(said.where("keep").select(key), key, "left_semi").select(key)
    members = merged.unionByName(kept).distinct()
    return Reconciled("done" if pending.isEmpty() else "halted", members, pending, lineage(strategy, *names))


def automatic(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, strategy: str | None) -> Reconciled | None:
    """What a fetch may land by itself: only with a strategy declared, and only where no verdict is needed."""
    if strategy is None:
        return None
    done = land(base, ours, theirs, key, strategy)
    return done if done.status == "done" else None


def local_work(pulled: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """(added, removed): how far the members differ from what was pulled."""
    mine, there = present.select(key).distinct(), pulled.select(key).distinct()
    return mine.join(there, key, "left_anti").agg(F.count(F.lit(1)).alias("added")).crossJoin(there.join(mine, key, "left_anti").agg(F.count(F.lit(1)).alias("removed")))


def discarded(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Members that a pull took away."""
    return before.select(key).distinct().join(after.select(key), key, "left_anti")


def snapshot(members: DataFrame, key: str) -> str:
    """A name for a set of members, whatever their order: a digest of their number and their summed hashes."""
    r = members.select(F.col(key).cast("string").alias("k")).distinct().agg(F.count(F.lit(1)), F.sum(F.xxhash64("k").cast("decimal(38,0)"))).first()
    return hashlib.sha256(f"{r[0]}/{r[1]}".encode()).hexdigest()


def history(snapshots: DataFrame, head: str) -> DataFrame:
    """(id) of a snapshot and all its ancestors; ``snapshots``: (snapshot, parents)."""
    edges = snapshots.select(F.explode("parents").alias("src"), F.col("snapshot").alias("dst"))
    return closure(edges, snapshots.where(F.col("snapshot") == head).select(F.col("snapshot").alias("id")))


def doctor(members: DataFrame, blobs: DataFrame, tombstones: DataFrame, indexed: DataFrame) -> DataFrame:
    """(check, n): members, those without bytes and without a tombstone, bytes that don't hash to their digest, members that the
    indices lack, and indexed blocks that are no members. Members and indexed: (id, digest) and (id)."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
    lost = members.join(blobs.select("digest"), "digest", "left_anti").join(tombstones.select("digest"), "digest", "left_anti")
    wrong = blobs.where(F.col("data").isNotNull() & (F.concat(F.lit("sha256:"), F.sha2("data", 256)) != F.col("digest")))
    rows = [one("members", members), one("missing", lost), one("corrupt", wrong), one("unindexed", members.join(indexed, "id", "left_anti")), one("foreign", indexed.join(members, "id", "left_anti"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
