"""Approximate nearest neighbours by balanced posting lists (Chen et al., "SPANN", 2021).

1. Centroids: about one for every ``sqrt(n)`` vectors, at least one for ``list_size``: vectors of the smallest seeded
   hashes, moved by Lloyd rounds over all vectors. Lists that are still too long are split into centroids of their own.
2. Centroids are broadcast and held in memory by every Python worker as a proximity graph; a best-first search over it
   finds the centroids near a vector, for a whole batch of vectors at once. About sqrt(n) centroids: 32 MB for 10**10
   vectors of 64 numbers.
3. Every vector goes to the list of its nearest centroid, and boundary vectors to further ones, up to ``REPLICAS``: those
   within a ratio of the least distance. The paper also skips a list whose centroid is nearer to one chosen before than to
   the vector; with vectors of many even dimensions that is always so and would leave no replica, so it isn't done.
4. As a query, a vector probes all lists within a (larger) ratio of the least distance, and the nearest ones until they
   hold enough vectors. Where the search over the graph ends before the ratio does, all centroids are compared: there are
   no more of them than vectors in a few lists. Neighbouring short lists are one bundle, which a query meets once and
   compares whole. Bundles are joined with their probes by bounded blocks of vectors and of queries, and the best ``k`` of
   all blocks are kept for each query.
"""

from __future__ import annotations

import io
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import best_columns
from .common import materialize, maybe_broadcast, q

K, LIST_SIZE, DEGREE, BEAM = 10, 128, 24, 48
#: Most lists that hold a vector.
REPLICAS = 4
#: On 51,282 vectors of 64 even dimensions: some 4 lists hold a vector, a query probes some 65 of 227, recall@10 is about 0.97.
BOUNDARY, PROBE = 1.1, 1.12
#: Lloyd rounds at least, and at most while a list is longer than twice the mean.
ROUNDS, MOST_ROUNDS = 3, 8
#: Vectors of one bundle of lists that are compared at once; a longer list is several parts, each of which meets all its probes.
PART = 4096
#: Queries that meet a part at once; more are several slices.
SLICE = 1 << 17


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean, [len(a), len(b)]."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


class Graph:
    """Centroids with edges to the nearest others, both ways, and entry points spread over them."""

    def __init__(self, centroids: np.ndarray, degree: int = DEGREE):
        self.points = np.ascontiguousarray(centroids, np.float32)
        n = len(centroids)
        near = np.empty((n, min(degree, max(0, n - 1))), np.int32)
        for at in range(0, n, 512):
            d = distances(self.points[at : at + 512], self.points)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            near[at : at + 512] = np.argpartition(d, near.shape[1] - 1, axis=1)[:, : near.shape[1]] if near.shape[1] else near[at : at + 512]
        back: list[list[int]] = [[] for _ in range(n)]
        for i, row in enumerate(near.tolist()):
            for j in row:
                if len(back[j]) < degree:
                    back[j].append(i)
        self.edges = np.repeat(np.arange(n, dtype=np.int32)[:, None], near.shape[1] + degree, 1)  # padded with the node itself
        self.edges[:, : near.shape[1]] = near
        for i, row in enumerate(back):
            self.edges[i, near.shape[1] : near.shape[1] + len(row)] = row
        self.entries = np.arange(0, n, max(1, n // max(1, math.isqrt(n))), dtype=np.int32)

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances), nearest first, of about the ``beam`` nearest centroids of every row of ``x``."""
        n, rows = len(self.points), np.arange(len(x))[:, None]
        beam = min(beam, n)
        norms = (self.points * self.points).sum(1)
        own = (x * x).sum(1)[:, None]
        d = distances(x, self.points[self.entries])
        top = np.argsort(d, axis=1, kind="stable")[:, :beam]
        ids, best = self.entries[top], d[rows, top]
        done = np.zeros((len(x), n), bool)  # expanded nodes
        live = np.arange(len(x))
        while len(live):
            fresh = ~done[live[:, None], ids[live]]
            width = min(4, ids.shape[1])
            order = np.argsort(np.where(fresh, best[live], np.inf), axis=1, kind="stable")[:, :width]
            node = np.take_along_axis(ids[live], order, 1)
            some = np.take_along_axis(fresh, order, 1)
            keep = some.any(1)
            live, node = live[keep], node[keep]
            if not len(live):
                break
            done[live[:, None], node] = True
            near = self.edges[node].reshape(len(live), -1)
            dist = np.maximum(own[live] + norms[near] - 2 * np.einsum("rd,rkd->rk", x[live], self.points[near]), 0)
            pool_ids, pool = np.concatenate([ids[live], near], 1), np.concatenate([best[live], dist], 1)
            order = np.argsort(pool_ids, axis=1, kind="stable")  # a node counts once
            pool_ids, pool = np.take_along_axis(pool_ids, order, 1), np.take_along_axis(pool, order, 1)
            pool[:, 1:][pool_ids[:, 1:] == pool_ids[:, :-1]] = np.inf
            order = np.argsort(pool, axis=1, kind="stable")[:, :beam]
            if ids.shape[1] < order.shape[1]:
                more = order.shape[1] - ids.shape[1]
                ids, best = np.pad(ids, ((0, 0), (0, more)), mode="edge"), np.pad(best, ((0, 0), (0, more)), constant_values=np.inf)
            ids[live], best[live] = np.take_along_axis(pool_ids, order, 1), np.take_along_axis(pool, order, 1)
        order = np.argsort(best, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(best, order, 1)


def chosen_lists(dist: np.ndarray, ratio: float) -> np.ndarray:
    """Which of the found lists, nearest first, count: those within ``ratio`` of the least distance."""
    ok = np.isfinite(dist) & (dist <= ratio * ratio * dist[:, :1] + 1e-12)
    ok[:, 0] = True
    return ok


def probed(graph: Graph, x: np.ndarray, counts: np.ndarray, ratio: float, least: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): all lists within ``ratio`` of the least distance, and the nearest until they hold ``least`` vectors."""
    rows, lists = [], []

    def add(which, ids, dist):
        # a vector close to its centroid has hardly a ratio to go by: lists count until they hold enough vectors
        before = np.cumsum(counts[ids], axis=1) - counts[ids]
        chosen = chosen_lists(dist, ratio) | ((before < least) & np.isfinite(dist))
        row, col = np.nonzero(chosen & (counts[ids] > 0))
        rows.append(which[row])
        lists.append(ids[row, col])
        return chosen[:, -1]

    ids, dist = graph.search(x, beam)
    n, everyone = len(graph.points), np.arange(len(x))
    if ids.shape[1] >= n and np.isfinite(dist).all():
        add(everyone, ids, dist)
    else:
        on = add(everyone, ids, dist)  # the last one found counts, so others beyond the beam may
        rows[0], lists[0] = rows[0][~on[rows[0]]], lists[0][~on[rows[0]]]
        block = max(1, (1 << 22) // n)
        for which in np.split(everyone[on], range(block, int(on.sum()), block)):
            d = distances(x[which], graph.points)
            order = np.argsort(d, axis=1, kind="stable")
            add(which, order, np.take_along_axis(d, order, 1))
    return np.concatenate(rows), np.concatenate(lists)


def bundles(points: np.ndarray, counts: np.ndarray, most: int = PART) -> np.ndarray:
    """The bundle of every list: neighbouring lists that hold at most ``most`` vectors together, a longer one by itself."""
    out, n, open_ = np.zeros(len(points), np.int32), 0, [np.arange(len(points))]
    while open_:
        own = open_.pop()
        total = counts[own].sum()
        if len(own) == 1 or total <= most:
            out[own], n = n, n + 1
            continue
        own = own[np.argsort(points[own, points[own].var(0).argmax()], kind="stable")]
        half = min(max(1, int(np.searchsorted(np.cumsum(counts[own]), total / 2))), len(own) - 1)
        open_ += [own[:half], own[half:]]
    return out


_loaded: dict[str, Graph] = {}


def _graph(key: str, payload: bytes) -> Graph:
    """The graph of a broadcast payload, built once for each Python worker and kept until another is asked for."""
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Graph(np.load(io.BytesIO(payload))["points"])
    return _loaded[key]


def vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): usable vectors scaled to length one; null ids and null, empty, zero or partly null or NaN vectors are left out."""
    v = q(vec_col)
    clean = table.where(q(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))
    raw = clean.select(q(id_col).alias("id"), v.cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return raw.withColumn("norm", norm).where("norm > 0").select("id", F.transform("v", lambda x: (x / F.col("norm")).cast("float")).alias("v"))


def _stack(column) -> np.ndarray:
    """[rows, width] from an Arrow list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float32)


def train_centroids(points: DataFrame, n: int, list_size: int, rounds: int = ROUNDS, seed: int = 17) -> np.ndarray:
    """Centroids by Lloyd rounds over all vectors; lists longer than twice the mean get more centroids each round, and rounds go
    on, up to ``MOST_ROUNDS``, until there is none. Equal vectors can't be split; their list is cut into parts later."""
    per = max(list_size, math.isqrt(n))
    count = max(1, -(-n // per))
    first = points.orderBy(F.xxhash64("id", "v", F.lit(seed)), "id").limit(count).select("v").toArrow()
    centres = np.unique(_stack(first.column("v").combine_chunks()), axis=0)
    spark = points.sparkSession
    width = centres.shape[1]
    for turn in range(max(rounds, MOST_ROUNDS)):
        payload = spark.sparkContext.broadcast(_pack(centres))
        key = uuid.uuid4().hex

        def assign(parts, payload=payload, key=key):
            sums: dict[int, np.ndarray] = {}
            graph = _graph(key, payload.value)
            total, squares, counts = np.zeros((len(graph.points), width)), np.zeros((len(graph.points), width)), np.zeros(len(graph.points), np.int64)
            for b in parts:
                x = _stack(b.column("v")) if b.num_rows else np.empty((0, width), np.float32)
                for at in range(0, len(x), 1024):
                    block = x[at : at + 1024]
                    nearest = graph.search(block, 16)[0][:, 0]
                    np.add.at(total, nearest, block)
                    np.add.at(squares, nearest, block * block)
                    np.add.at(counts, nearest, 1)
            used = np.flatnonzero(counts)
            if len(used):
                yield pa.RecordBatch.from_pydict({"c": used.astype(np.int32), "n": counts[used], "s": list(total[used]), "ss": list(squares[used])})

        partial = points.select("v").mapInArrow(assign, "c int, n long, s array<double>, ss array<double>")
        place = partial.select("c", "n", F.posexplode(F.arrays_zip("s", "ss")).alias("i", "z"))
        rows = place.groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("z.s").alias("s"), F.sum("z.ss").alias("ss")).toPandas()
        payload.unpersist()
        rows = rows.sort_values(["c", "i"])
        n_of = rows.groupby("c")["n"].first().to_numpy()
        mean = (rows["s"].to_numpy() / rows["n"].to_numpy()).reshape(-1, width)
        spread = np.sqrt(np.maximum((rows["ss"].to_numpy() / rows["n"].to_numpy()).reshape(-1, width) - mean**2, 0))
        # a long list becomes several centroids, moved apart along the dimensions of most spread
        out = [mean]
        long = [i for i in np.flatnonzero(n_of > 2 * per) if spread[i].max() > 1e-6]
        for i in long:
            rng = np.random.default_rng(seed + int(i))
            more = min(int(n_of[i] // per), 64)
            out.append(mean[i] + rng.normal(size=(more, width)) * spread[i])
        centres = np.unique(np.concatenate(out).astype(np.float32), axis=0)
        if turn + 1 >= rounds and not long:
            break
    return centres


def _pack(centres: np.ndarray) -> bytes:
    buffer = io.BytesIO()
    np.savez(buffer, points=centres)
    return buffer.getvalue()


def neighbours(table: DataFrame, k: int = K, list_size: int = LIST_SIZE, boundary: float = BOUNDARY, probe: float = PROBE, beam: int = BEAM, id_col: str = "vec_id", vec_col: str = "embedding", queries: DataFrame | None = None) -> DataFrame:
    """(id, neighbour, rank, similarity): for every query its ``k`` nearest others by cosine, approximately; recall is at
    least 0.9 on the tested tables.

    Every row is indexed and a candidate, and a query too unless ``queries`` has others. Rows that share an id are one point each, and rows of one id are no neighbours
    of each other; if they differ, that id gets the best ``k`` over all of them. Equal similarities are ranked by id. Rows
    with a null id or an unusable vector (null, empty, holding null or NaN, or of length zero) take no part. Vectors must
    be of one length. Fewer than ``k`` other ids give fewer rows, an empty table none. Other columns take no part.
    """
    points = materialize(vectors(table, id_col, vec_col), "ann-vectors")
    spark = table.sparkSession
    kind = dict(points.dtypes)["id"]
    shape = points.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
    n = shape[0]
    names = (id_col, "neighbour", "rank", "similarity")
    if not n:
        return spark.createDataFrame([], f"a {kind}, b {kind}, r int, s double").toDF(*names)
    if shape[1] != shape[2]:
        raise ValueError("vectors must be of one length")
    width = shape[1]
    wanted = points if queries is None else materialize(vectors(queries, id_col, vec_col), "ann-queries")
    if queries is not None and not wanted.where(F.size("v") != width).isEmpty():
        raise ValueError("queries must be of the length of the vectors")
    centres = train_centroids(points, n, list_size)
    lists = spark.sparkContext.broadcast(_pack(centres))  # n / max(list_size, sqrt(n)) vectors
    key = uuid.uuid4().hex

    def rows_of(row, value, size, b, at):
        """The rows of a block with their distinct values, a list each; ``row`` counts from the block's first row."""
        pairs = np.unique((row.astype(np.int64) << 32) | value)
        ends = np.concatenate([[0], np.cumsum(np.bincount(pairs >> 32, minlength=size))])
        values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)))
        return pa.RecordBatch.from_arrays([values, b.column("id").slice(at, size), b.column("v").slice(at, size)], names=["lists", "id", "v"])

    def blocks(parts):
        for b in parts:
            x = _stack(b.column("v")) if b.num_rows else np.empty((0, width), np.float32)
            for at in range(0, len(x), 1024):
                yield b, at, x[at : at + 1024]

    def place(parts):
        graph = _graph(key, lists.value)
        for b, at, x in blocks(parts):
            ids, dist = graph.search(x, beam)
            ids, dist = ids[:, :REPLICAS], dist[:, :REPLICAS]
            row, col = np.nonzero(chosen_lists(dist, boundary))
            yield rows_of(row, ids[row, col], len(x), b, at)

    schema = f"lists array<int>, id {kind}, v array<float>"
    held = materialize(points.mapInArrow(place, schema), "ann-lists")

    def counted(df, size):
        known = df.select(F.explode("lists").alias("list")).groupBy("list").count().toPandas()
        counts = np.zeros(size, np.int64)
        counts[known["list"].to_numpy(int)] = known["count"].to_numpy(np.int64)
        return counts

    counts = counted(held, len(centres))  # one for each centroid, which the driver holds already
    bundle_of = bundles(centres, counts)
    least = max(8 * k, 2 * list_size)

    def ask(parts):
        graph = _graph(key, lists.value)
        for b, at, x in blocks(parts):
            row, found = probed(graph, x, counts, probe, least, beam)
            yield rows_of(row, bundle_of[found], len(x), b, at)

    def bundled(parts):
        for b in parts:
            for at in range(0, b.num_rows, 1024):
                own = b.slice(at, 1024)
                row = np.repeat(np.arange(own.num_rows), own.column("lists").value_lengths().to_numpy())
                yield rows_of(row, bundle_of[own.column("lists").flatten().to_numpy()], own.num_rows, own, 0)

    asked = materialize(wanted.mapInArrow(ask, schema), "ann-asked")
    total = np.bincount(bundle_of, weights=counts).astype(np.int64)
    asks = counted(asked, len(total))
    shapes = [(i, max(1, -(-int(t) // PART)), max(1, -(-int(a) // SLICE))) for i, (t, a) in enumerate(zip(total, asks))]
    shapes = maybe_broadcast(spark.createDataFrame(shapes, "list int, parts int, slices int"), len(shapes), 24)
    hashed = F.xxhash64("id", "v")
    part, slice_ = (F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("parts", "slices"))
    held = held.mapInArrow(bundled, schema).select(F.explode("lists").alias("list"), "id", "v").join(shapes, "list")
    held = held.select("list", F.pmod(hashed, F.col("parts")).cast("int"), slice_, "id", "v").toDF("hl", "hp", "hs", "hid", "hv")
    asked = asked.select(F.explode("lists").alias("list"), "id", "v").join(shapes, "list")
    asked = asked.select("list", part.alias("part"), F.pmod(hashed, F.col("slices")).cast("int").alias("slice"), "id", "v")
    id_type = pa.int64() if kind == "bigint" else None

    def best(queries: pa.Table, items: pa.Table) -> pa.Table:
        out_q, out_n, out_s = [], [], []
        ids = items.column("hid").combine_chunks() if items.num_rows else None
        if items.num_rows and queries.num_rows:
            y = _stack(items.column("hv").combine_chunks())
            code = {v: i for i, v in enumerate(dict.fromkeys(ids.to_pylist()))}
            y_code = np.array([code[v] for v in ids.to_pylist()])
            most = int(np.bincount(y_code).max())  # rows of one id: so many times k rows hold the best k ids
            q_ids = queries.column("id").combine_chunks()
            x = _stack(queries.column("v").combine_chunks())
            q_code = np.array([code.get(v, -1) for v in q_ids.to_pylist()])
            order_of = np.argsort(np.argsort(np.array(list(code), dtype=object), kind="stable"))[y_code] if len(code) else y_code
            for at in range(0, len(x), 1024):
                s = x[at : at + 1024] @ y.T
                s[q_code[at : at + 1024, None] == y_code[None, :]] = -np.inf
                # ties at the cut go to the smaller id, here as in the end
                order = best_columns(s, order_of, k * most)
                top = np.take_along_axis(s, order, 1)
                row, col = np.nonzero(np.isfinite(top))
                out_q.append(row + at)
                out_n.append(order[row, col])
                out_s.append(top[row, col])
        if not out_q:
            empty = pa.array([], id_type or queries.schema.field("id").type)
            return pa.Table.from_arrays([empty, empty, pa.array([], pa.float64())], names=["a", "b", "s"])
        return pa.Table.from_arrays([q_ids.take(pa.array(np.concatenate(out_q))), ids.take(pa.array(np.concatenate(out_n))), pa.array(np.concatenate(out_s).astype(np.float64))], names=["a", "b", "s"])

    pairs = asked.groupBy("list", "part", "slice").cogroup(held.groupBy("hl", "hp", "hs")).applyInArrow(best, f"a {kind}, b {kind}, s double")
    # an id may be met in several lists and by several rows: its best similarity counts
    met = pairs.groupBy("a", "b").agg(F.max("s").alias("s"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("d"), F.col("b")))), 1, k)
    ranked = met.groupBy("a").agg(top.alias("t")).select("a", F.posexplode("t").alias("r", "x"))
    return ranked.select(F.col("a"), F.col("x.b").alias("b"), (F.col("r") + 1).alias("r"), F.round(-F.col("x.d"), 6).alias("s")).toDF(*names)


def query(spark, sf_dir: str) -> DataFrame:
    """All rows are indexed; the stated queries are the rows whose id is divisible by 50."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours(table, queries=table.where("vec_id % 50 = 0"))
