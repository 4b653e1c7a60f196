"""Exact dedup by a heavy-hitter split.

1. One scan writes a compact table (64-bit digest, SHA-256, doc_id, row hash): no text is shuffled.
2. Misra-Gries summaries of the 64-bit digests, one per partition, are added up; every digest held by more than
   ``2 / counters`` of the rows is certain to be found, and at most ``counters`` digests are kept.
3. The winners of those digests are verified by SHA-256 (digests that only collide never merge) and broadcast: their
   copies leave map-side. All remaining digests are grouped by an ordinary shuffle of the compact rows.
4. The rows that lose are removed from the documents by an anti join: broadcast while the losers are few, by a shuffle
   beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_winners, materialize, q, row_hash


def misra_gries(batches: Iterator[np.ndarray], counters: int) -> dict[int, int]:
    """Misra-Gries summary of a stream of arrays: each count is short of the true one by at most n / (counters + 1)."""
    held: dict[int, int] = {}
    for values in batches:
        found, counts = np.unique(values, return_counts=True)
        for v, c in zip(found.tolist(), counts.tolist()):
            held[v] = held.get(v, 0) + c
        if len(held) > counters:
            cut = int(np.partition(np.fromiter(held.values(), np.int64, len(held)), -counters - 1)[-counters - 1])
            held = {v: c - cut for v, c in held.items() if c > cut}
    return held


def heavy_digests(digests: DataFrame, counters: int) -> list[tuple[int, int]]:
    """Digests of at least 1/counters of all rows by the summed summaries, with their summed (low) counts."""

    def summarise(parts):
        held = misra_gries((b.column(0).to_numpy(zero_copy_only=False) for b in parts if b.num_rows), counters)
        yield pa.RecordBatch.from_pydict({"h": pa.array(list(held), pa.int64()), "n": pa.array(list(held.values()), pa.int64())})

    rows = digests.count()
    least = max(2, -(-rows // counters))
    summed = digests.select("h").mapInArrow(summarise, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return [(r.h, r.n) for r in summed.where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(counters).collect()]


def groups(docs: DataFrame, id_col: str, text_col: str, counters: int) -> DataFrame:
    """Rows whose text occurs more than once: (id, row, wid, wrow), the row's own key and that of the row that stays."""
    compact = materialize(
        docs.where(q(text_col).isNotNull()).select(
            F.xxhash64(q(text_col)).alias("h"),
            F.unhex(F.sha2(q(text_col), 256)).alias("sha"),
            q(id_col).alias("id"),
            row_hash(docs).alias("row"),
        ),
        "exact-digests",
    )

    def winners(rows: DataFrame) -> DataFrame:
        # a struct's null fields sort first, so whether the id is null leads
        least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("w")
        return rows.groupBy("h", "sha").agg(least, F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "sha", F.col("w.id").alias("wid"), F.col("w.row").alias("wrow"))

    heavy = heavy_digests(compact, counters)
    if not heavy:
        return compact.join(winners(compact), ["h", "sha"]).select("id", "row", "wid", "wrow")
    frequent = F.broadcast(docs.sparkSession.createDataFrame([(h,) for h, _ in heavy], "h long"))  # at most `counters` rows
    light = compact.join(frequent, "h", "left_anti")
    found = winners(compact.join(frequent, "h", "left_semi"))  # partial aggregation leaves a row for each digest and task
    verified = F.broadcast(materialize(found, "exact-heavy"))
    removed = compact.join(verified, ["h", "sha"]).select("id", "row", "wid", "wrow")
    return removed.unionByName(light.join(winners(light), ["h", "sha"]).select("id", "row", "wid", "wrow"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 1024) -> DataFrame:
    """Rows of ``docs`` without the copies of a text, all columns as they were.

    Of rows with the same text the one with the smallest id stays; null ids come last; ties on the id go to the smallest
    hash over all columns, and of rows equal in every column one stays. A null text is no text: such rows all stay. Empty
    texts are texts and equal each other. Texts of any length are compared whole, by SHA-256. An empty table gives an empty
    table. Extra columns of any name pass through.
    """
    return keep_winners(docs, groups(docs, id_col, text_col, counters), id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents
) WHERE rn = 1 OR text IS NULL
"""
