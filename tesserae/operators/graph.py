"""Graph index: neighbours, bounded expansion with decay, closure, degrees and reach, over edges (src, dst, kind, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved

DECAY = 0.5


def neighbours(edges: DataFrame, ids: list, inbound: bool = False, kinds: list[str] | None = None) -> DataFrame:
    near, far = ("dst", "src") if inbound else ("src", "dst")
    out = edges.where(F.col(near).isin(ids))
    return (out if kinds is None else out.where(F.col("kind").isin(kinds))).select(F.col(far).alias("id"), "kind", "weight")


def expand(edges: DataFrame, seeds: DataFrame, depth: int, decay: float = DECAY, inbound: bool = False, kinds: list[str] | None = None, predicates: list[str] | None = None, most: int | None = None) -> DataFrame:
    """(id, score, depth): what ``seeds`` (id) reach in up to ``depth`` hops, by the best product of weight * decay over
    paths and the fewest hops; seeds are left out. ``inbound`` walks edges backwards; ``kinds`` and ``predicates`` say which
    edges count; ``most`` keeps the best of (score, id). Every hop is a join and an aggregation to one row for each node."""
    near, far = ("dst", "src") if inbound else ("src", "dst")
    out = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    out = out if predicates is None else out.where(F.col("predicate").isin(predicates))
    out = out.select(F.col(near).alias("near"), F.col(far).alias("far"), "weight")
    start = seeds.select("id").distinct()
    front = start.select("id", F.lit(1.0).alias("score"))
    reached = None
    for hop in range(1, depth + 1):
        front = front.join(out, front["id"] == out["near"]).groupBy(F.col("far").alias("to")).agg(F.max(F.col("score") * F.col("weight") * F.lit(decay)).alias("score")).withColumnRenamed("to", "id")
        here = front.withColumn("depth", F.lit(hop))
        reached = here if reached is None else reached.unionByName(here)
    best = reached.groupBy("id").agg(F.max("score").alias("score"), F.min("depth").alias("depth")).join(start, "id", "left_anti")
    return best if most is None else best.orderBy(F.desc("score"), "id").limit(most)


def federated(graphs: list[DataFrame], seeds: DataFrame, depth: int, **options) -> DataFrame:
    """Each graph expanded by itself, best score and least depth kept: no path changes graphs."""
    rows = expand(graphs[0], seeds, depth, **options)
    for g in graphs[1:]:
        rows = rows.unionByName(expand(g, seeds, depth, **options))
    return rows.groupBy("id").agg(F.max("score").alias("score"), F.min("depth").alias("depth"))


def later_edges(edges: DataFrame) -> DataFrame:
    """One edge for each pair of ends: of (src, dst, at, ...) the one of the greatest ``at``, weights in thousandths."""
    rest = [c for c in edges.columns if c not in ("src", "dst", "at")]
    last = edges.groupBy("src", "dst").agg(F.max(F.struct("at", *rest)).alias("m")).select("src", "dst", *[F.col(f"m.{c}") for c in rest])
    return last.withColumn("weight", F.round("weight", 3))


def external(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(id): targets that no member is."""
    return edges.select(F.col("dst").alias("id")).distinct().join(members.select("id"), "id", "left_anti")


def density(edges: DataFrame) -> DataFrame:
    """(density): edges over nodes."""
    return degrees(edges).select(F.round(F.col("edges") / F.col("nodes"), 6).alias("density"))


def sampled(nodes: DataFrame, most: int = 128) -> DataFrame:
    """The starts that reach is measured from: the ``most`` nodes of the smallest digests, the same in every run."""
    return nodes.select("id").distinct().orderBy(F.md5(F.col("id").cast("string")), "id").limit(most)


def degrees(edges: DataFrame) -> DataFrame:
    """(nodes, edges, mean, most): over nodes with an edge out or in."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("out")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("out")))
    per = ends.groupBy("id").agg(F.sum("out").alias("d"))
    return per.agg(F.count(F.lit(1)).alias("nodes"), F.sum("d").alias("edges"), F.round(F.avg("d"), 6).alias("mean"), F.max("d").alias("most"))


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(depth, reach): the mean number of nodes that a start reaches within each depth."""
    seen = starts.select(F.col("id").alias("start"), "id").distinct()
    total = seen.agg(F.count(F.lit(1)).alias("n"))
    out = None
    for hop in range(1, depth + 1):
        step = seen.join(edges.select("src", "dst"), F.col("id") == F.col("src")).select("start", F.col("dst").alias("id"))
        seen = seen.unionByName(step).distinct()
        row = seen.where("id <> start").agg(F.count(F.lit(1)).alias("c")).crossJoin(total).select(F.lit(hop).alias("depth"), F.round(F.col("c") / F.col("n"), 6).alias("reach"))
        out = row if out is None else out.unionByName(row)
    return out


def closure(edges: DataFrame, seeds: DataFrame, save=saved) -> DataFrame:
    """(id): all that depends on ``seeds`` over edges dst <- src, seeds included, however long the chains are.

    ``save`` writes each round out, which cuts lineage, so a round costs one join of the edges with what was new in the last.
    Rounds go on until one finds nothing; cycles end, since nothing is found twice."""
    edges = save(edges.select("src", "dst"), "closure-edges")
    found = front = save(seeds.select("id").distinct(), "closure")
    while not front.isEmpty():
        nxt = edges.join(front, F.col("dst") == F.col("id")).select(F.col("src").alias("id")).distinct().join(found, "id", "left_anti")
        front = save(nxt, "closure")
        found = found.unionByName(front)
    return found
