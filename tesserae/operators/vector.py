"""Vector index: exact cosine search, hashing vectors, best chunk for each block, recall against the exact answer."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring
from ..functions.text import VALUES, analyse, lengths, runs

#: Vectors and queries of one key that are compared at once.
PART, SLICE = 4096, 1 << 16


def brute_vector(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding", mask: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """(id, score): the k unit vectors of most cosine, or all with k = 0, clamped at 0, those of ``least`` or more, ties by id. The
    mask is applied before the cut."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    if mask is not None:
        rows = rows.join(mask.select("id"), "id", "left_semi")
    q = F.lit(query) if not isinstance(query, list) else F.array(*[F.lit(float(x)) for x in query])
    scored = rows.select("id", F.greatest(F.lit(0.0), scoring.dot(F.col("v"), q)).alias("score"))
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), "id").limit(k) if k else scored


def hashed_terms(docs: DataFrame, dims: int = scoring.DIMS) -> DataFrame:
    """(id, bucket, value): sparse unit vectors of the signed token counts of (id, tokens), made inside each text."""
    return docs.select("id", "tokens").mapInArrow(lambda parts: _sparse(parts, dims), f"id {dict(docs.dtypes)['id']}, bucket int, value double")


def _sparse(parts, dims: int):
    """Flat rows of the vectors of batches of (id, tokens), of some texts at a time."""
    known = scoring.Hashed(dims)
    for b in parts:
        sizes = lengths(b.column("tokens"))
        for at, n in runs(sizes):
            m = scoring.hashing_matrix(b.column("tokens").slice(at, n).flatten(), np.repeat(np.arange(n), sizes[at : at + n]), n, known, dims)
            row, bucket = np.nonzero(m)
            yield pa.RecordBatch.from_arrays([b.column("id").slice(at, n).take(pa.array(row)), pa.array(bucket.astype(np.int32)), pa.array(m[row, bucket])], names=["id", "bucket", "value"])


def hashed_vectors(texts: Column | str, dims: int = scoring.DIMS) -> Column:
    """Dense unit vectors of whole texts; null for a text without a token."""
    known = scoring.Hashed(dims)  # for all batches of a task

    def dense(values: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], pa.list_(pa.float64())), *_dense(values, known)])

    return F.arrow_udf(dense, "array<double>")(texts)


def _dense(texts: pa.Array, known: scoring.Hashed):
    """Arrays of the vectors, of some texts each."""
    for i in range(0, len(texts), VALUES):
        found = [analyse(t or "") for t in texts.slice(i, VALUES).to_pylist()]
        m = scoring.hashing_matrix([w for x in found for w in x], np.repeat(np.arange(len(found)), [len(x) for x in found]), len(found), known, known.dims)
        none = ~m.any(1)
        ends = np.append(0, np.cumsum(np.where(none, 0, known.dims))).astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(ends), pa.array(m[~none].ravel()), mask=pa.array(none))


def with_vectors(pieces: DataFrame, text: str, name: str, dims: int = scoring.DIMS) -> DataFrame:
    """The rows whose text has a token, with its vector instead of it. As a column its test for null would make every vector twice."""
    kept = [c for c in pieces.columns if c != text]

    def add(parts):
        known = scoring.Hashed(dims)
        for b in parts:
            at = 0
            for v in _dense(b.column(text), known):
                rows = b.select(kept).slice(at, len(v))
                yield pa.RecordBatch.from_arrays([*rows.columns, v], names=[*kept, name]).filter(v.is_valid())
                at += len(v)

    return pieces.mapInArrow(add, T.StructType([f for f in pieces.schema if f.name != text]).add(name, T.ArrayType(T.DoubleType())))


def best_chunk(hits: DataFrame) -> DataFrame:
    """(block, score, chunk): the best of each block's chunks, clamped at 0; ties keep the first chunk."""
    best = F.max(F.struct(F.col("score"), (-F.col("chunk")).alias("c"))).alias("m")
    return hits.groupBy("block").agg(best).select("block", F.greatest(F.lit(0.0), F.col("m.score")).alias("score"), (-F.col("m.c")).alias("chunk"))


def _best_of_keys(held: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(key, q, id, score): the k ids of most cosine for every row of asked (key, q, qv) among each block of the held (key, id, v).

    Each key's rows meet as blocks of bounded size, hashed by id. There are few keys, so their counts are broadcast.
    """
    sizes = held.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    sizes = F.broadcast(sizes.join(asked.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices")), "key"))
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = lambda i, c: F.pmod(F.xxhash64(i), F.col(c)).cast("int")
    held = held.join(sizes, "key").select("key", one("id", "parts").alias("part"), each("slices").alias("slice"), "id", "v")
    asked = asked.join(sizes, "key").select("key", each("parts").alias("part"), one("q", "slices").alias("slice"), "q", "qv")
    kinds = dict(asked.dtypes)["q"], dict(held.dtypes)["id"]
    stack = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1).astype(np.float64)

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, cols, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if left.num_rows and right.num_rows:
            x, y = stack(left.column("qv")), stack(right.column("v"))
            q, ids = left.column("q").to_numpy(), right.column("id").to_numpy()
            most = np.unique(ids, return_counts=True)[1].max()  # rows of one id
            place = np.argsort(np.argsort(ids, kind="stable"))
            for at in range(0, len(x), 256):
                s = np.round(x[at : at + 256] @ y.T, 6)
                s[q[at : at + 256, None] == ids[None, :]] = -np.inf
                order = scoring.best_columns(s, place, k * most)
                top = np.take_along_axis(s, order, 1)
                row, col = np.nonzero(np.isfinite(top))
                rows.append(row + at)
                cols.append(order[row, col])
                scores.append(top[row, col])
        picked = left.column("q").take(pa.array(np.concatenate(rows))), right.column("id").take(pa.array(np.concatenate(cols)))
        key = pa.array(np.full(len(picked[0]), left.column("key")[0].as_py() if left.num_rows else 0, np.int32))
        return pa.Table.from_arrays([key, *picked, pa.array(np.concatenate(scores))], names=["key", "q", "id", "score"])

    keys = ["key", "part", "slice"]
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(best, f"key int, q {kinds[0]}, id {kinds[1]}, score double")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def cosine_join(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(q, id, score, rank): the k nearest of every query, exactly; any number of queries, null vectors left out."""
    asked = queries.where(F.col(vec_col).isNotNull()).select(F.lit(0).alias("key"), F.col(id_col).alias("q"), F.col(vec_col).alias("qv"))
    held = vectors.where(F.col(vec_col).isNotNull()).select(F.lit(0).alias("key"), F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    return _ranked(_best_of_keys(held, asked, k).drop("key"), k)


def lsh_pairs(vectors: DataFrame, queries: DataFrame, k: int, bits: int = 6, tables: int = 16, seed: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, probes: int = 4) -> DataFrame:
    """(q, id, score, table): vectors whose sign pattern over random planes a query asks for, the k best of each pattern,
    with the first table that has them. The tables of a smaller number are the first ones of a larger.

    In each table a query asks for ``probes`` patterns: its own, and those got by crossing the planes that it is nearest to
    (Lv et al., "Multi-Probe LSH", 2007).
    """
    planes = np.random.default_rng(seed).normal(size=(tables, bits, dims))
    flips = np.arange(1 << bits)
    crossed = (flips[:, None] >> np.arange(bits) & 1).astype(float)

    def buckets(probes: int):
        @F.pandas_udf("array<int>")
        def keys(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_list()) if len(v) else np.empty((0, dims))
            margins = np.einsum("nd,tbd->ntb", x, planes)
            own = (margins > 0) @ (1 << np.arange(bits))
            cost = np.abs(margins) @ crossed.T  # of crossing each set of planes; none for the own pattern
            near = flips[np.argsort(cost, axis=2, kind="stable")[:, :, :probes]]
            out = (own[:, :, None] ^ near) + (np.arange(tables) << bits)[:, None]
            return pd.Series(list(out.reshape(len(x), tables * near.shape[2]).astype(np.int32)))

        return keys(F.col(vec_col))

    held = vectors.where(F.col(vec_col).isNotNull()).select(F.explode(buckets(1)).alias("key"), F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    asked = queries.where(F.col(vec_col).isNotNull()).select(F.explode(buckets(probes)).alias("key"), F.col(id_col).alias("q"), F.col(vec_col).alias("qv"))
    table = F.shiftright(F.min("key"), bits).alias("table")
    return _best_of_keys(held, asked, k).groupBy("q", "id").agg(F.max("score").alias("score"), table)


def lsh_search(vectors: DataFrame, queries: DataFrame, k: int, bits: int = 6, tables: int = 16, seed: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = 64, probes: int = 4) -> DataFrame:
    """(q, id, score, rank): the approximate probe, the pairs of ``lsh_pairs`` re-ranked exactly."""
    return _ranked(lsh_pairs(vectors, queries, k, bits, tables, seed, id_col, vec_col, dims, probes).drop("table"), k)


def recall(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(recall): the mean share of each query's exact k that were found."""
    hits = exact.join(found.select("q", "id", F.lit(1).alias("hit")), ["q", "id"], "left")
    return hits.groupBy("q").agg((F.count("hit") / F.lit(k)).alias("r")).agg(F.round(F.avg("r"), 6).alias("recall"))


def recall_by_tables(exact: DataFrame, met: DataFrame, k: int, efforts: tuple[int, ...]) -> DataFrame:
    """(effort, recall): the recall of ``lsh_search`` with so many tables, of its pairs with the most of them.

    One of the exact k that is met is among the best k of those met, so it needs no ranking.
    """
    hits = exact.select("q", "id").join(met.select("q", "id", "table"), ["q", "id"], "left")
    each = hits.groupBy("q").agg(*[(F.count(F.when(F.col("table") < n, 1)) / F.lit(k)).alias(f"r{n}") for n in efforts])
    curve = each.select(F.explode(F.array(*[F.struct(F.lit(n).alias("effort"), F.col(f"r{n}").alias("r")) for n in efforts])).alias("x"))
    return curve.groupBy(F.col("x.effort").alias("effort")).agg(F.round(F.avg("x.r"), 6).alias("recall"))


def project_2d(points: np.ndarray) -> np.ndarray:
    """The first two principal axes of a few result vectors, signs fixed, scaled to -1..1; for the driver."""
    x = points - points.mean(0)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    out = (u * s)[:, :2]
    out = out * np.where(out[np.abs(out).argmax(0), range(out.shape[1])] < 0, -1, 1)
    return out / max(1e-12, np.abs(out).max())
