"""Rank fusion and the fixed tail of a search: accessibility, residual, reserve, verification, limit, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring


def ranked(rows: DataFrame, generator: str, k: int, depth: int = 0, exact: bool = False) -> DataFrame:
    """(id, generator, rank, depth, exact) of a generator's best k, by score, then id."""
    top = rows.orderBy(F.desc("score"), "id").limit(k)  # TakeOrderedAndProject; what the window sorts is k rows
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    return top.select("id", F.lit(generator).alias("generator"), rank.alias("rank"), F.lit(depth).alias("depth"), F.lit(exact).alias("exact"))


def fuse(lists: list[DataFrame], weights: dict[str, float], default: float = 0.5) -> DataFrame:
    """(id, score, depth, exact): weighted reciprocal ranks of all lists; one generator counts by its best rank; +1 for an
    exact hit; halved for every hop of depth. Parts are added in the order of the generators' names, so the full value is the
    same in every run, and ranking goes by the full value."""
    rows = lists[0]
    for x in lists[1:]:
        rows = rows.unionByName(x)
    per = rows.groupBy("id", "generator").agg(F.min("rank").alias("rank"), F.min("depth").alias("depth"), F.max("exact").alias("exact"))
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("generator")), F.lit(default)) if weights else F.lit(default)
    part = F.struct("generator", scoring.reciprocal_rank(F.col("rank"), weight).alias("x"))
    out = per.groupBy("id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.min("depth").alias("depth"), F.max("exact").alias("exact"))
    total = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p["x"])
    score = total * F.pow(F.lit(0.5), F.col("depth")) + F.when(F.col("exact"), 1.0).otherwise(0.0)
    return out.select("id", score.alias("score"), "depth", "exact")


def accessible(rows: DataFrame, superseded: DataFrame, include: bool = False) -> DataFrame:
    return rows if include else rows.join(superseded.select("id"), "id", "left_anti")


def top(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.desc("score"), "depth", "id").limit(limit)


def normalised(rows: DataFrame) -> DataFrame:
    """Scores over the best one, rendered; the full score is shown to 9 places."""
    best = F.max("score").over(Window.partitionBy())
    return rows.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "depth", "id")).alias("rank"), F.round("score", 9).alias("score"), scoring.render(F.col("score") / best).alias("shown"))


def verified(rows: DataFrame, members: DataFrame, blobs: DataFrame) -> DataFrame:
    """Rows that are members and whose stored bytes still hash to their id."""
    kept = rows.join(members.select("id"), "id", "left_semi").join(blobs.select("id", "digest", "data"), "id")
    return kept.where(F.concat(F.lit("sha256:"), F.sha2(F.col("data"), 256)) == F.col("digest")).drop("data")


def bundle(rows: DataFrame, limit: int) -> DataFrame:
    """The evidence rows, each with whether more than ``limit`` matched."""
    ahead = rows.orderBy(F.desc("score"), "depth", "id").limit(limit + 1)
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "depth", "id"))
    return ahead.withColumn("rank", rank).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) > limit).where(F.col("rank") <= limit)
