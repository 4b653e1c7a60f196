"""Statistics of the indices and the estimates that are read from them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import saved


def facet_counts(rows: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value, count, nulls included as null values)"""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])).alias("p")
    return rows.select(pairs).select("p.facet", "p.value").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(rows: DataFrame, facets: list[str], n: int = 32) -> DataFrame:
    """(facet, value, count, place): the n most frequent values of every facet, ties by value."""
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("count"), "value"))
    return facet_counts(rows, facets).where("value is not null").withColumn("place", place).where(F.col("place") <= n)


def numbered(rows: DataFrame, order: list, name: str = "r") -> DataFrame:
    """``rows`` with their place from 0 in the order given: sorted by range partitions and written out, so the partitions that
    are counted are those that are numbered, and no task sees all rows."""
    placed = saved(rows.sort(*order).withColumn("__p", F.spark_partition_id()), "numbered")
    counts = placed.groupBy("__p").agg(F.count(F.lit(1)).alias("c"))
    before = counts.select("__p", F.sum("c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1 + F.coalesce("before", F.lit(0))
    return placed.join(F.broadcast(before), "__p").withColumn(name, place).drop("__p", "before")


def histogram(rows: DataFrame, key: str, buckets: int = 32) -> DataFrame:
    """(bucket, low, high, count): equally deep; a remainder makes further buckets. ``high`` is the first value of the next
    bucket, of the last one the greatest value."""
    keyed = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("k"))
    ranked = numbered(keyed, ["k"])
    total = ranked.agg(F.count(F.lit(1)).alias("n"))
    per = F.greatest(F.lit(1), F.floor(F.col("n") / buckets))
    found = ranked.crossJoin(F.broadcast(total)).groupBy(F.floor(F.col("r") / per).cast("int").alias("bucket"))  # one row
    found = found.agg(F.min("k").alias("low"), F.max("k").alias("top"), F.count(F.lit(1)).alias("count"))
    following = F.lead("low").over(Window.orderBy("bucket"))  # a few buckets
    return found.select("bucket", "low", F.coalesce(following, "top").alias("high"), "count")


def duplicates(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """(key, count, least): keys of more than one row. Digests are grouped; a key itself is fetched for the least id alone."""
    digests = rows.where(F.col(key).isNotNull()).select(F.sha2(F.col(key).cast("string"), 256).alias("d"), id_col)
    many = digests.groupBy("d").agg(F.count(F.lit(1)).alias("count"), F.min(id_col).alias("least")).where("count > 1")
    held = rows.select(F.col(id_col).alias("least"), F.sha2(F.col(key).cast("string"), 256).alias("d"), key)
    return held.join(many, ["least", "d"]).dropDuplicates(["d"]).select(key, "count", "least")


def fingerprint(rows: DataFrame, id_col: str) -> DataFrame:
    """(digest): SHA-256 of the sorted ids, one a line. A digest is sequential, so the sorted ids stream through the driver, a
    partition at a time."""
    digest = hashlib.sha256()
    for i, r in enumerate(rows.select(F.col(id_col).cast("string").alias("id")).sort("id").toLocalIterator(prefetchPartitions=True)):
        digest.update((("\n" if i else "") + r.id).encode())
    return rows.sparkSession.createDataFrame([(digest.hexdigest(),)], "digest string")


def percentiles(rows: DataFrame, key: str, fractions: list[float]) -> DataFrame:
    """(fraction, value): nearest rank, never interpolated."""
    ranked = numbered(rows.where(F.col(key).isNotNull()).select(F.col(key).alias("value")), ["value"])
    total = ranked.agg(F.count(F.lit(1)).alias("n"))
    wanted = total.select("n", F.explode(F.array(*map(F.lit, fractions))).alias("fraction")).select("fraction", F.least(F.col("n") - 1, F.floor(F.col("fraction") * F.col("n"))).alias("r"))
    return ranked.join(F.broadcast(wanted), "r").select("fraction", "value")  # a row for each fraction


def column_statistics(rows: DataFrame, facets: list[str], n: int = 32) -> DataFrame:
    """(facet, distinct, nulls, truncated): truncated tells that there are more than ``n`` values."""
    counts = facet_counts(rows, facets)
    per = counts.groupBy("facet").agg(F.count("value").alias("distinct"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("nulls"))
    return per.withColumn("truncated", F.col("distinct") > n)


def selectivity(rows: DataFrame, facet: str, values: list[str], n: int = 32) -> DataFrame:
    """(value, rows, exact, measured): what ``column_estimate`` makes of the most frequent values, beside the true count."""
    head = {r.value: r["count"] for r in top_values(rows, [facet], n).collect()}  # at most n rows
    about = column_statistics(rows, [facet], n).first()
    total = rows.count()
    made = [(v, *column_estimate(v, head, total, about["distinct"], about["truncated"])) for v in values]
    told = rows.sparkSession.createDataFrame([(v, int(k), bool(e)) for v, k, e in made], "value string, rows long, exact boolean")
    true = rows.where(F.col(facet).cast("string").isin(values)).groupBy(F.col(facet).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("measured"))
    return told.join(F.broadcast(true), "value", "left").select("value", "rows", "exact", F.coalesce("measured", F.lit(0)).alias("measured"))


def term_statistics(frequencies: DataFrame, head: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(head, tail): the ``head`` most frequent (term, df), and (terms, most) of the rest."""
    kept = frequencies.orderBy(F.desc("df"), "term").limit(head)
    rest = frequencies.join(kept.select("term"), "term", "left_anti")
    return kept, rest.agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.max("df"), F.lit(0)).alias("most"))


def term_estimate(term: str, head: dict[str, int], tail_most: int, known: bool = True) -> int:
    """Exact for a frequent term, the most of the tail for another known one, 0 for an unseen one."""
    return head.get(term, tail_most if known else 0)


def cardinality(rows: DataFrame, size: str) -> DataFrame:
    """(n, average): rows, and the mean size of those that have one."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col(size) > 0, F.col(size))), 6).alias("average"))


def column_estimate(value: str, head: dict[str, int], total: int, distinct: int, truncated: bool) -> tuple[int, bool]:
    """(rows, exact) with a value, from the most frequent values and the totals."""
    if value in head:
        return head[value], True
    if not truncated and distinct <= len(head):
        return 0, True
    return min(total, max(1, (total - sum(head.values())) // max(1, distinct - len(head)))), False


def range_estimate(bounds: list, counts: list[int], low, high) -> float:
    """Rows in a window by the histogram: buckets inside count whole, those cut count half."""
    if not counts or (high is not None and high < bounds[0]) or (low is not None and low > bounds[-1]):
        return 0
    out = 0.0
    for i, c in enumerate(counts):
        a, b = bounds[i], bounds[i + 1]
        if (low is not None and b < low) or (high is not None and a > high):
            continue
        out += c if (low is None or a >= low) and (high is None or b <= high) else c / 2
    return out


def recall_at(curve: list[tuple[int, float]], effort: int) -> float:
    """Linear between measured points; 0.8 without any."""
    if not curve:
        return 0.8
    if effort <= curve[0][0]:
        return curve[0][1]
    for (a, x), (b, y) in zip(curve, curve[1:]):
        if effort <= b:
            return x + (y - x) * (effort - a) / (b - a)
    return curve[-1][1]


def graph_estimate(seeds: int, depth: int, measured: list[float], degree: float) -> float:
    return seeds * (measured[depth - 1] if 0 < depth <= len(measured) else max(1.0, degree) ** depth)
