"""Lifecycle: identity, registration, deltas, retention, reconciliation and Merkle roots, as set algebra over tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved
from .stats import numbered


def with_block_id(docs: DataFrame, text_col: str = "text", name: str = "block_id") -> DataFrame:
    return docs.withColumn(name, F.concat(F.lit("sha256:"), F.sha2(F.col(text_col), 256)))


def register(incoming: DataFrame, held: DataFrame, key: str = "block_id") -> DataFrame:
    """The incoming blocks that aren't held yet, one for each key; the rest are duplicates."""
    return incoming.dropDuplicates([key]).join(held.select(key), key, "left_anti")


def pull_outcomes(items: DataFrame, registered: DataFrame, origin: str, tombstones: DataFrame, digest: str) -> DataFrame:
    """Items with an outcome: redacted bytes and known origins are skipped, known content is a duplicate, the rest registers."""
    known = registered.select(F.col(origin).alias("o")).distinct()
    same = registered.select(F.col(digest).alias("d")).distinct()
    gone = tombstones.select(F.col(digest).alias("t")).distinct()
    joined = items.join(known, F.col(origin) == F.col("o"), "left").join(same, F.col(digest) == F.col("d"), "left").join(gone, F.col(digest) == F.col("t"), "left")
    outcome = F.when(F.col("t").isNotNull() | F.col("o").isNotNull(), "skipped").when(F.col("d").isNotNull(), "duplicate").otherwise("registered")
    return joined.withColumn("outcome", outcome).drop("o", "d", "t")


def delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or unchanged."""
    a, b = before.select(F.col(key).alias("a")).distinct(), after.select(F.col(key).alias("b")).distinct()
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("unchanged")
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias(key), change.alias("change"))


def delta_summary(changes: DataFrame) -> DataFrame:
    """(added, removed, unchanged, noop, rebuild): nothing to do, or more than half of what was held is gone."""
    n = lambda k: F.count_if(F.col("change") == k)
    per = changes.agg(n("added").alias("added"), n("removed").alias("removed"), n("unchanged").alias("unchanged"))
    held = F.col("removed") + F.col("unchanged")
    return per.select("added", "removed", "unchanged", ((F.col("added") == 0) & (F.col("removed") == 0)).alias("noop"), (F.col("removed") * 2 > held).alias("rebuild"))


def reconcile(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Members after both histories: additions of either side stay, removals of either side win."""
    flags = None
    for i, side in enumerate((base, ours, theirs)):
        rows = side.select(key, F.lit(1 << i).alias("f")).distinct()
        flags = rows if flags is None else flags.unionByName(rows)
    held = flags.groupBy(key).agg(F.sum("f").alias("f"))
    return held.where("f = 7 or f in (2, 4, 6)").select(key)


def conflicts(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """(key, side): base members that one side alone removed, to be accepted or refused."""
    o, t = ours.select(key, F.lit(True).alias("o")).distinct(), theirs.select(key, F.lit(True).alias("t")).distinct()
    both = base.select(key).distinct().join(o, key, "left").join(t, key, "left")
    return both.where(F.col("o").isNull() != F.col("t").isNull()).select(key, F.when(F.col("o").isNull(), "ours").otherwise("theirs").alias("side"))


def prune_plan(blobs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    return blobs.join(members.select(key).distinct(), key, "left_anti")


def resolvability(members: DataFrame, blobs: DataFrame, tombstones: DataFrame, key: str) -> DataFrame:
    """(state, count): resolvable, tombstoned or missing."""
    b, t = blobs.select(key, F.lit(1).alias("b")).distinct(), tombstones.select(key, F.lit(1).alias("t")).distinct()
    state = F.when(F.col("t").isNotNull(), "tombstoned").when(F.col("b").isNotNull(), "resolvable").otherwise("missing")
    return members.join(b, key, "left").join(t, key, "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("count"))


def validation(candidates: DataFrame, held: DataFrame, key: str, evidence: str, threshold: float = 0.5) -> DataFrame:
    """Candidates with a status: no evidence is rejected, known ones are duplicates, low confidence waits for review."""
    known = held.select(F.col(key).alias("k")).distinct()
    status = F.when(F.coalesce(F.size(evidence), F.lit(0)) <= 0, "rejected").when(F.col("k").isNotNull(), "duplicate").when(F.col("confidence").cast("double") < threshold, "pending_review").otherwise("validated")
    return candidates.join(known, F.col(key) == F.col("k"), "left").withColumn("status", status).drop("k")


def contradicted(candidates: DataFrame, held: DataFrame) -> DataFrame:
    """Validated candidates that say something else under the label of a block that stands are contradicted. ``held``: (label,
    statement)."""
    said = held.where(F.col("label").isNotNull()).groupBy(F.lower(F.trim("label")).alias("hl")).agg(F.collect_set("statement").alias("said"))
    rows = candidates.join(said, F.lower(F.trim(F.col("label"))) == F.col("hl"), "left")
    other = (F.col("status") == "validated") & F.col("said").isNotNull() & ~F.coalesce(F.array_contains("said", F.col("statement")), F.lit(False))
    return rows.withColumn("status", F.when(other, "contradicted").otherwise(F.col("status"))).drop("hl", "said")


def commit(candidates: DataFrame) -> DataFrame:
    """All or nothing: the validated candidates, or none while one is rejected or pending."""
    blocked = candidates.agg(F.count_if(F.col("status").isin("rejected", "pending_review", "contradicted")).alias("blocked"))
    return candidates.crossJoin(F.broadcast(blocked)).where("blocked = 0 and status = 'validated'").drop("blocked")


def _pair(a: bytes, b: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + a + b).digest()


def merkle_levels(ids: list[str]) -> list[list[bytes]]:
    """Levels of the tree over the sorted ids: leaves are hashed with a zero byte ahead, nodes with a one; an odd last
    node goes up as it is."""
    level = [hashlib.sha256(b"\x00" + x.encode()).digest() for x in sorted(ids)]
    levels = [level]
    while len(level) > 1:
        level = [_pair(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        levels.append(level)
    return levels


def merkle_tables(ids: DataFrame) -> list[DataFrame]:
    """The levels of the same tree as tables (r, h), h in hex, from the leaves up: sorted and numbered by range partitions, then
    each level is an aggregation of the one below."""
    leaf = F.sha2(F.concat(F.unhex(F.lit("00")), F.col("id").cast("binary")), 256)
    level = saved(numbered(ids.select(F.col("id").cast("string").alias("id")), ["id"]).select("r", leaf.alias("h")), "merkle")
    levels, n = [level], level.count()
    while n > 1:
        pair = level.groupBy(F.floor(F.col("r") / 2).alias("r")).agg(F.array_sort(F.collect_list(F.struct("r", "h"))).alias("x"))
        both = F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(F.col("x")[0]["h"]), F.unhex(F.get("x", F.lit(1))["h"])), 256)
        level = saved(pair.select("r", F.when(F.size("x") == 2, both).otherwise(F.col("x")[0]["h"]).alias("h")), "merkle")
        levels, n = [*levels, level], -(-n // 2)
    return levels


def merkle_root_of(levels: list[DataFrame]) -> str:
    top = levels[-1].first()
    return top.h if top else hashlib.sha256(b"").hexdigest()


def merkle_proofs(levels: list[DataFrame], places: DataFrame) -> DataFrame:
    """(r, proof): for the leaves at the few places (r) the path of (level, side, h), which ``merkle_verify`` takes. Each level
    is read once for all of them."""
    at = places.select("r", F.col("r").alias("at"))
    steps = None
    for i, level in enumerate(levels[:-1]):
        other = F.col("at") + F.when(F.col("at") % 2 == 0, 1).otherwise(-1)
        side = F.when(F.col("at") % 2 == 0, "right").otherwise("left")
        got = F.broadcast(at.withColumn("other", other)).join(level.select(F.col("r").alias("other"), "h"), "other").select("r", F.struct(F.lit(i).alias("level"), side.alias("side"), "h").alias("s"))
        steps = got if steps is None else steps.unionByName(got)
        at = at.withColumn("at", F.floor(F.col("at") / 2))
    none = F.array().cast("array<struct<level:int,side:string,h:string>>")
    if steps is None:
        return places.select("r", none.alias("proof"))
    per = steps.groupBy("r").agg(F.array_sort(F.collect_list("s")).alias("proof"))
    return places.select("r").join(per, "r", "left").select("r", F.coalesce("proof", none).alias("proof"))


def merkle_root(ids: list[str]) -> str:
    levels = merkle_levels(ids)
    return levels[-1][0].hex() if levels[0] else hashlib.sha256(b"").hexdigest()


def merkle_proof(ids: list[str], one: str) -> list[tuple[str, str]]:
    at, out = sorted(ids).index(one), []
    for level in merkle_levels(ids)[:-1]:
        other = at ^ 1
        if other < len(level):
            out.append(("left" if other < at else "right", level[other].hex()))
        at //= 2
    return out


def merkle_verify(one: str, proof: list[tuple[str, str]], root: str) -> bool:
    h = hashlib.sha256(b"\x00" + one.encode()).digest()
    for side, other in proof:
        h = _pair(bytes.fromhex(other), h) if side == "left" else _pair(h, bytes.fromhex(other))
    return h.hex() == root
