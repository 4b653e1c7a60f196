"""A search over stored indices as lazy DataFrames: masks, generators, fusion, accessibility, residual filters, reserve,
verification, limit and payload. The planner chooses which generators run; the tail is the same for every plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import analyse, query_terms, query_tokens
from ..operators import fusion, masks
from ..operators.indices import IndexSet
from .planner import MOST_HOPS, PROFILES, Filters, Plan, Query, Statistics, choose, explain

EXPANDED = 20
RESULT = "id long, memory_type string, rank int, score double, shown string, content string, evidence array<string>, superseded_by string, resolvable boolean, truncated boolean"


def query_vector(text: str, dims: int = scoring.DIMS) -> list[float]:
    """The hashing vector of a query, made on the driver as that of every block."""
    return scoring.hashing_vector(analyse(text), dims=dims).tolist()


def matches(f: Filters) -> Column:
    """The filters on a block's own fields, raw: what masks by indices only prepare. A missing field matches nothing."""
    keep = F.lit(True)
    if f.subject:
        keep = keep & (F.col("subject") == f.subject)
    if f.since:
        keep = keep & (F.col("occurred_at") >= f.since)
    if f.until:
        keep = keep & (F.col("occurred_at") <= f.until)
    for column, wanted in (("tags", f.tags), ("evidence", f.evidence)):
        if wanted:
            keep = keep & (F.size(F.array_except(F.array(*map(F.lit, wanted)), F.coalesce(column, F.array().cast("array<string>")))) == 0)
    return F.coalesce(keep, F.lit(False))


@dataclass
class Found:
    """What a search gives: the evidence, what had to be worked around, and the plan with its intent."""

    bundle: DataFrame
    degradations: DataFrame
    intent: str
    plan: Plan
    considered: list[Plan]


class Engine:
    """Search, explain and analyse over an ``IndexSet``. ``ledger``: (block_id, superseded_by), accessibility only. ``crossover``:
    the number of blocks up to which the scan is taken; without it the costs alone decide."""

    def __init__(self, indices: IndexSet, ledger: DataFrame | None = None, crossover: int | None = None):
        self.indices, self.ledger, self.spark, self.crossover = indices, ledger, indices.spark, crossover

    def choose(self, query: Query) -> tuple[str, Plan, list[Plan]]:
        return choose(query, self.indices.statistics(), self.indices.predicates(), self.indices.unseen(query_terms(query.text)) if query.text.strip() else 0.0, crossover=self.crossover)

    def _ranked(self, rows: DataFrame, scope: str, generator: str, k: int, depth: int = 0, exact: bool = False) -> DataFrame:
        """The best k and one more, which tells that there were more; ranks count from 1 in each scope and generator."""
        top = rows.orderBy(F.desc("score"), "id").limit(k + 1)
        rank = F.row_number().over(Window.orderBy(F.desc("score"), "id"))  # over k + 1 rows
        return top.select("id", F.lit(generator).alias("generator"), F.lit(scope).alias("scope"), rank.alias("rank"), F.lit(depth).alias("depth"), F.lit(exact).alias("exact"), (rank > k).alias("cut"))

    def _lists(self, query: Query, plan: Plan) -> list[DataFrame]:
        ix, f, out = self.indices, query.filters, []
        held: dict[str, DataFrame | None] = {}

        def mask(scope):
            if scope not in held:
                held[scope] = ix.mask(scope, f.subject, f.tags, f.since, f.until)
            return held[scope]

        for n in plan.nodes:
            if n.op == "exact":
                rows = masks.masked(ix.exact(n.scope, query.text), mask(n.scope))
                out.append(self._ranked(rows, n.scope, "exact", plan.pool, exact=True))
            elif n.op == "seq":
                rows = masks.masked(ix.scan(n.scope, query_tokens(query.text) if query.text.strip() else []), mask(n.scope))
                out.append(self._ranked(rows, n.scope, "seq", max(plan.pool, ix.statistics()[n.scope].blocks)))
            elif n.op == "term":
                out.append(self._ranked(ix.term(n.scope, query_terms(query.text), mask(n.scope)), n.scope, "term", n.get("k")))
            elif n.op in ("brute", "vector"):
                out.append(self._ranked(ix.vectors(n.scope, query_vector(query.text), mask(n.scope)), n.scope, n.op, n.get("k")))
            elif n.op == "graph" and out and ix.graphs():
                seeds = self._union([x.where("depth = 0 and not cut").select("id") for x in out]).distinct()
                hits = ix.expand(seeds, min(n.get("depth"), MOST_HOPS), most=EXPANDED * 4)
                owners = ix["blocks"].select(F.col("block_id").alias("id"), "memory_type")
                hits = masks.federated_mask(hits, owners, {s: mask(s) for s in ix.statistics()})
                out.append(self._ranked(hits.select("id", "score"), n.scope, "graph", EXPANDED, depth=1))
        return out

    @staticmethod
    def _union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def run(self, query: Query, plan: Plan, kind: str) -> tuple[DataFrame, DataFrame]:
        """(bundle, degradations) of a plan, lazily. The bundle has at most ``limit`` rows in order of rank; what fails the checks
        is replaced from a reserve of as many and reported."""
        ix, f, limit = self.indices, query.filters, max(1, query.limit)
        lists = self._lists(query, plan)
        if not lists:
            return self.spark.createDataFrame([], RESULT), self.spark.createDataFrame([], "kind string, id long")
        rows = self._union(lists)
        fused = fusion.fuse([rows.where("not cut").drop("cut", "scope")], PROFILES[kind][0])
        content = rows.where("not cut and generator not in ('exact', 'graph')").select("id").distinct().withColumn("read", F.lit(True))
        if self.ledger is not None and not f.include_superseded:
            fused = fused.join(self.ledger.select(F.col("block_id").alias("id")), "id", "left_anti")
        blocks = ix["blocks"]
        fields = ["memory_type", "content", "digest", "subject", "tags", "occurred_at", "evidence"]
        if f.of_blocks:  # before the reserve, so matches far down aren't hidden by others above them
            kept = blocks.where(F.col("content").isNotNull() & matches(f)).select(F.col("block_id").alias("id")).distinct()
            fused = fused.join(kept, "id", "left_semi")
        order = [F.desc("score"), "depth", "id"]
        ahead = fused.orderBy(*order).limit(2 * limit + 1)
        place = F.row_number().over(Window.orderBy(*order))  # over the reserve
        pool = ahead.withColumn("place", place).withColumn("over", F.count(F.lit(1)).over(Window.partitionBy()) > 2 * limit).where(F.col("place") <= 2 * limit)
        pool = pool.withColumn("share", F.col("score") / F.max("score").over(Window.partitionBy()))
        # resolve and verify: a member, its bytes hash to its digest; bytes that are gone are an answer only where no content was read
        held = F.broadcast(pool).join(blocks.select(F.col("block_id").alias("id"), *fields).dropDuplicates(["id"]), "id", "left").join(content, "id", "left")
        good = F.col("memory_type").isNotNull() & (F.col("content").isNull() | (F.concat(F.lit("sha256:"), F.sha2("content", 256)) == F.col("digest")))
        stale = good & F.col("content").isNull() & F.col("read").isNotNull()
        state = F.when(~good, "verification_failed").when(stale, "index_stale")
        checked = held.withColumn("state", state)
        kept = checked.where("state is null").withColumn("rank", F.row_number().over(Window.orderBy(*order)))
        total = F.count(F.lit(1)).over(Window.partitionBy())
        cut = rows.agg(F.max("cut").alias("cut"))
        kept = kept.withColumn("n", total).where(F.col("rank") <= limit).crossJoin(F.broadcast(cut))  # one row
        if self.ledger is not None:
            kept = kept.join(F.broadcast(self.ledger.select(F.col("block_id").alias("id"), F.col("superseded_by").cast("string").alias("superseded_by"))), "id", "left") if f.include_superseded else kept.withColumn("superseded_by", F.lit(None).cast("string"))
        else:
            kept = kept.withColumn("superseded_by", F.lit(None).cast("string"))
        truncated = F.col("over") | (F.col("n") > limit) | F.coalesce("cut", F.lit(False))
        bundle = kept.select("id", "memory_type", "rank", F.round("score", 9).alias("score"), scoring.render(F.col("share")).alias("shown"), "content", "evidence", "superseded_by", F.col("content").isNotNull().alias("resolvable"), truncated.alias("truncated"))
        return bundle, checked.where("state is not null").select(F.col("state").alias("kind"), "id")

    def search(self, query: Query) -> Found:
        kind, plan, plans = self.choose(query)
        bundle, degraded = self.run(query, plan, kind)
        return Found(bundle, degraded, kind, plan, plans)

    def explain(self, query: Query, analyse: bool = False) -> dict:
        """The plan and its reasons; with ``analyse`` the generators run and their rows are counted beside the estimates."""
        stats, actual = self.indices.statistics(), None
        known = {"predicates": self.indices.predicates(), "unseen": self.indices.unseen(query_terms(query.text)) if query.text.strip() else 0.0, "crossover": self.crossover}
        if analyse:
            _, plan, _ = choose(query, stats, **known)
            ran = [i for i, n in enumerate(plan.nodes) if n.op in ("exact", "seq", "term", "brute", "vector", "graph")]
            actual = {i: x.where("not cut").count() for i, x in zip(ran, self._lists(query, plan))}
        return explain(query, stats, actual, **known)


def diagnostics(engine: Engine, bundle: DataFrame, query: Query, most: int = 40, around: int = 5) -> dict:
    """Small views of a result for a reader: edges among and around it, its vectors in two dimensions, and its neighbours by time.
    A result has at most ``limit`` rows, so all of this is small."""
    from ..operators.vector import project_2d

    ids = [r.id for r in bundle.select("id").collect()]
    ix = engine.indices
    near = ix["edges"].where(F.col("src").isin(ids) | F.col("dst").isin(ids)).orderBy("src", "dst").limit(most)
    points = ix["vectors"].where(F.col("block_id").isin(ids) & (F.col("chunk") == 0)).select("block_id", "v").orderBy("block_id").collect()
    stack = [query_vector(query.text), *(p.v for p in points)]
    import numpy as np

    placed = project_2d(np.array(stack)) if len(stack) > 2 else np.zeros((len(stack), 2))
    low, high = query.filters.since, query.filters.until
    times = ix["keys"].where("key = 'occurred_at'")
    inside = times if low is None else times.where(F.col("value") >= low)
    inside = inside if high is None else inside.where(F.col("value") <= high)
    before = times.where(F.col("value") < low).orderBy(F.desc("value")).limit(around) if low is not None else times.limit(0)
    window = [*reversed(before.collect()), *inside.orderBy("value", "block_id").limit(2 * around).collect()]
    return {
        "edges": [(r.src, r.dst, r.kind) for r in near.collect()], "window": [(r.block_id, r.value) for r in window],
        "points": [("query", *placed[0].tolist()), *((p.block_id, *xy) for p, xy in zip(points, placed[1:].tolist()))],
    }


__all__ = ["Engine", "Filters", "Found", "Query", "Statistics", "diagnostics", "matches", "query_vector"]
