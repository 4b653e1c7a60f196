"""N-gram Jaccard join by parity sketches.

A document is the set of its word n-grams. Every n-gram is hashed to one bit of a sketch of blocks and XORed in,
so a bit is the parity of its n-grams and the Hamming distance of two sketches is at most the symmetric difference of the
sets. Two sets with Jaccard >= t whose smaller one has at most s members differ in at most D = (1 - t) / t * s n-grams,
hence in at most D blocks: with m = D + 1 + x blocks they agree on x + 1 or more (pigeonhole). So each document may leave
out the x blocks that come first in a fixed order of block values - commonest first, since blocks of few and common words
agree by chance. The order is a function of a block's bits: the document frequencies of the n-grams on them, as a bounded
sample has them, the same for all; it decides what is compared, never what is found. What two documents leave out of their
common blocks is the same end of one order, so if each leaves out x - y blocks, they still share y + 1. Equal blocks are
joined within size bands (powers of 1 / t; a band meets itself and the next), pairs that share fewer than y + 1 blocks go,
and every other pair is verified on the sets. A pair meets in one band only, so the bands are worked through in a few
passes, and what a pass shuffled is deleted before the next.

Documents with the same set are one node of the join, so copies cost nothing. Families of near copies aren't expanded into
pairs either: a few pairs for each node, with the least and the greatest node of its heaviest blocks, are verified first and
join most of every family to one component; then all blocks are joined, but only between components. So every link between
components is found, and the links inside one are counted by products of incidence matrices where they are asked for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import WORD, WordHashes, discard, keep_winners, maybe_broadcast, mix64, ngram_hashes, q, row_hash

THRESHOLD, NGRAM = 0.85, 1
#: x and y as shares of D + 1.
SLACK, SPARE = 0.4, 0.05
#: Nodes that document frequencies are sampled from, and n-grams whose frequency is kept.
SAMPLE, KNOWN = 4000, 1 << 15
#: Passes at most, and the keys from which a second one is made.
PASSES, PASS_KEYS = 4, 1_000_000
#: Bits of a block; blocks that a node is looked up by in the first round; nodes that are compared at once.
WIDTH, HUB_KEYS, TILE = 1024, 4, 512

#: Whether the engine deletes the shuffle files of a query as soon as it has run.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """The scratch table of ``df``, with what was shuffled for it deleted once it is written: nothing reads it again."""
    conf = df.sparkSession.conf
    before = conf.get(FREE, "false")
    conf.set(FREE, "true")
    try:
        return common.materialize(df, label)
    finally:
        conf.set(FREE, before)


def ngram_set(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the word n-grams of a whole text; a text of fewer than n words is one n-gram."""
    words = WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint32)
    h = hashes.of(words)
    h = mix64(h) if n == 1 else ngram_hashes(h, min(n, len(h)))
    return np.unique((h >> np.uint64(32)).astype(np.uint32))


def set_hash(members: np.ndarray) -> int:
    """Signed 64-bit hash of a set: the sum of its mixed members."""
    return int(mix64(members.astype(np.uint64) + np.uint64(0x51ED270B0A1F39C1)).sum(dtype=np.uint64).astype(np.int64))


class Bands:
    """Size bands for a threshold, with the differences D and blocks m of each probe."""

    def __init__(self, threshold: float):
        self.ratio = 1 / (threshold - 1e-9)
        self.per_member = (1 - threshold) / threshold
        self.edges = self.ratio ** np.arange(0, 400)
        self.edges = self.edges[self.edges < 1e12]

    def of(self, size: int) -> int:
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def shape(self, probe: int) -> tuple[int, int, int]:
        """(D, m, y + 1): the most differing blocks when the smaller set is of band ``probe``, the blocks of a sketch, and
        how many of those kept are shared at least."""
        largest = int(np.ceil(self.edges[probe + 1])) - 1
        d = int(self.per_member * largest + 1e-6)
        return d, d + 1 + int(np.ceil(SLACK * (d + 1))), 1 + int(np.ceil(SPARE * (d + 1)))

    def needs(self, sizes: np.ndarray) -> np.ndarray:
        """y + 1 by the size of the smaller set."""
        bands = np.searchsorted(self.edges, sizes, side="right") - 1
        found, at = np.unique(bands, return_inverse=True)
        return np.array([self.shape(int(b))[2] for b in found], np.int32)[at]


def _places(members: np.ndarray, blocks: int) -> np.ndarray:
    """The bit of every n-gram in a sketch of so many blocks."""
    h = mix64(members.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (h >> np.uint64(8)) % np.uint64(blocks * WIDTH)


class Rarity:
    """Whole numbers for the bits of a sketch, larger for rarer n-grams: -8 log2 of the document frequency.

    A bit's number is that of the commonest known n-gram on it, so equal blocks have equal sums whatever n-grams they have.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, of: int):
        self.words, self.bits = words, np.rint(8 * np.log2(of / counts)).astype(np.int64)
        self.unseen, self.tables = int(np.rint(8 * np.log2(2 * max(of, 1)))), {}

    def at(self, places: np.ndarray, blocks: int) -> np.ndarray:
        if not len(self.words):
            return np.full(len(places), self.unseen)
        if blocks not in self.tables:
            known = _places(self.words, blocks)
            order = np.lexsort((self.bits, known))
            known, bits = known[order], self.bits[order]
            first = np.concatenate([[True], known[1:] != known[:-1]])
            self.tables[blocks] = known[first], bits[first]
        known, bits = self.tables[blocks]
        near = np.minimum(np.searchsorted(known, places), len(known) - 1)
        return np.where(known[near] == places, bits[near], self.unseen)


def sketch(members: np.ndarray, blocks: int, rarity: Rarity | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(value, weight) of every block: a hash of its parity bits and the number of them that are set, or the sum of their
    ``rarity``.

    The value is the XOR of a mixed word for every n-gram's bit, so n-grams that meet on a bit cancel out as its parity does.
    """
    at = np.sort(_places(members, blocks))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    odd = at[first][np.diff(np.concatenate([first, [len(at)]])) & 1 == 1]
    block = (odd // np.uint64(WIDTH)).astype(np.int64)
    weight = np.bincount(block, weights=None if rarity is None else rarity.at(odd, blocks), minlength=blocks)
    value = np.zeros(blocks, np.uint64)
    used = np.flatnonzero(np.bincount(block, minlength=blocks))
    if len(used):
        value[used] = np.bitwise_xor.reduceat(mix64(odd + np.uint64(1)), np.searchsorted(block, used))
    return value, weight


def block_keys(members: np.ndarray, bands: Bands, most: int | None = None, rarity: Rarity | None = None, probes: range | None = None) -> list[tuple[np.ndarray, bool]]:
    """The join keys of a set: for the probe of its own band and that of the band below, as far as they are in ``probes``,
    D + 1 + y hashes of (probe, block, value); with ``most`` so many of the heaviest."""
    band, out = bands.of(len(members)), []
    for probe in (band, band - 1):
        if probe < 0 or (probes is not None and probe not in probes):
            continue
        d, m, shared = bands.shape(probe)
        if d < 1:
            continue  # only equal sets can be that close, and those are one node
        values, weights = sketch(members, m, rarity)
        keys = mix64(values ^ mix64(np.arange(m, dtype=np.uint64) + np.uint64(probe << 32)))
        order = np.lexsort((keys, weights))[m - d - shared :]
        out.append((keys[order if most is None else order[-most:]], probe == band))
    return out


def _sets(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    source = docs.select(q(id_col).alias("id"), row_hash(docs).alias("row"), q(text_col).alias("text"))
    schema = f"id {dict(source.dtypes)['id']}, row long, node long, size int, members binary"

    def build(parts):
        hashes = WordHashes()
        for b in parts:
            found = [ngram_set(t.as_py(), n, hashes) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("row"), pa.array([set_hash(m) for m in found], pa.int64()),
                 pa.array([len(m) for m in found], pa.int32()), pa.array([m.tobytes() for m in found], pa.binary())],
                names=["id", "row", "node", "size", "members"],
            )

    return source.mapInArrow(build, schema).where("size > 0")


def _passes(nodes: DataFrame, threshold: float) -> tuple[int, list[range]]:
    """The number of nodes, and all probes in ranges of about as many keys each."""
    bands = Bands(threshold)
    near = F.least(F.floor(F.log("size") / float(np.log(bands.ratio))), F.lit(len(bands.edges) - 2)).cast("int").alias("band")
    held = {r.band: r.n for r in nodes.groupBy(near).agg(F.count(F.lit(1)).alias("n")).collect()}
    keys = np.zeros(max(held, default=0) + 1, np.int64)
    for probe in range(len(keys)):
        d, _, shared = bands.shape(probe)
        keys[probe] = (held.get(probe, 0) + held.get(probe + 1, 0)) * (d + shared) * (d > 0)
    passes = int(np.clip(-(-keys.sum() // PASS_KEYS), 1, PASSES))
    inner = np.searchsorted(np.cumsum(keys), keys.sum() * np.arange(1, passes) / passes) + 1
    cuts = [0, *sorted({int(x) for x in inner if x < len(keys)}), len(bands.edges)]
    return sum(held.values()), [range(a, b) for a, b in zip(cuts[:-1], cuts[1:])]


def _rarity(nodes: DataFrame, n: int) -> Rarity:
    """Document frequencies over about ``SAMPLE`` of the ``n`` nodes, which are hashes, of the ``KNOWN`` commonest n-grams."""
    some = nodes.where(F.pmod("node", F.lit(max(1, n // SAMPLE))) == 0).select("members")

    def count(parts):
        for b in parts:
            word, times = np.unique(np.concatenate([np.empty(0, np.uint32), *(np.frombuffer(m.as_buffer(), np.uint32) for m in b.column(0))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(times.astype(np.int64))], names=["word", "times"])

    counted = some.mapInArrow(count, "word long, times long").groupBy("word").agg(F.sum("times").alias("times"))
    found = counted.where("times > 1").orderBy(F.desc("times"), "word").limit(KNOWN).toArrow()
    words, times = found.column("word").to_numpy().astype(np.uint32), found.column("times").to_numpy()
    return Rarity(words, times, max(n // max(1, n // SAMPLE), int(times.max(initial=1))))


def _keys(nodes: DataFrame, threshold: float, most: int | None = None, rarity=None, probes: range | None = None) -> DataFrame:
    """(key, node, label, size) of every join key; a size below zero: of the band above the probe's. ``rarity`` is a broadcast."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("label", pa.int64()), ("size", pa.int32())])

    def emit(parts):
        bands, order = Bands(threshold), rarity and rarity.value
        for whole in parts:
            for start in range(0, whole.num_rows, 1024):  # some 100,000 keys at once
                b = whole.slice(start, 1024)
                keys, at, sizes = [], [], []
                for i, members in enumerate(b.column("members")):
                    m = np.frombuffer(members.as_buffer(), np.uint32)
                    for k, own in block_keys(m, bands, most, order, probes):
                        keys.append(k)
                        at.append(np.full(len(k), i))
                        sizes.append(np.full(len(k), len(m) if own else -len(m), np.int32))
                if keys:
                    at = pa.array(np.concatenate(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), b.column("node").take(at), b.column("label").take(at), pa.array(np.concatenate(sizes))], schema=schema)

    return nodes.select("node", "label", "members").mapInArrow(emit, "key long, node long, label long, size int")


def _hub_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of a node and the smallest and the largest set of one of its heaviest blocks: a few pairs for each node,
    which join most of a family of near copies. Hot blocks are aggregated before the shuffle."""
    keys = materialize(_keys(nodes, threshold, HUB_KEYS).select("key", "node", F.abs("size").alias("size")), "near-hub-keys")
    own = F.struct("size", "node")
    hubs = keys.groupBy("key").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo.node <> hi.node")
    both = keys.join(hubs, "key").select("node", "size", F.explode(F.array("lo", "hi")).alias("hub"))
    close = (F.col("hub.node") != F.col("node")) & (F.least("size", "hub.size") >= F.lit(threshold - 1e-9) * F.greatest("size", "hub.size"))
    return both.where(close).select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def _run_pairs(columns: list[np.ndarray], starts: np.ndarray, ends: np.ndarray, threshold: float, bands: Bands):
    """Pairs within each run [start, end), smaller node first, that have different labels, that the sizes allow and of which
    one is of the probe's band, with the number of blocks that they must share."""
    _, node, label, size = columns

    def allowed(i, j):
        a, b = np.abs(size[i]), np.abs(size[j])
        ok = ((size[i] > 0) | (size[j] > 0)) & (label[i] != label[j]) & (np.minimum(a, b) >= (threshold - 1e-9) * np.maximum(a, b))
        i, j = i[ok], j[ok]
        return np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), bands.needs(np.minimum(a[ok], b[ok]))

    two = ends - starts == 2
    if two.any():
        yield allowed(starts[two], starts[two] + 1)
    for s, e in zip(starts[~two].tolist(), ends[~two].tolist()):
        if e - s <= 512:
            i, j = np.triu_indices(e - s, 1)
            yield allowed(s + i, s + j)
        else:
            for i in range(s, e - 1):
                yield allowed(np.full(e - i - 1, i), np.arange(i + 1, e))


def _met(nodes: DataFrame, threshold: float, rarity, probes: range) -> DataFrame:
    """The keys (key, node, label, size) of ``probes`` that nodes of several labels have: a family that is one component
    already costs nothing more. One exchange, with windows that spill. Written out."""
    over, edges = Window.partitionBy("key"), Bands(threshold).edges
    here = nodes.where((F.col("size") >= float(edges[probes.start])) & (F.col("size") < float(edges[probes.stop + 1]) if probes.stop + 1 < len(edges) else F.lit(True)))
    keys = _keys(here, threshold, None, rarity, probes).withColumn("lo", F.min("label").over(over)).withColumn("hi", F.max("label").over(over))
    return materialize(keys.where("lo <> hi").drop("lo", "hi"), "near-met")


def _candidates(met: DataFrame, threshold: float) -> DataFrame:
    """Pairs of nodes of different labels that share enough of the keys."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("need", pa.int32())])

    def pair(parts):
        held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)]
        bands = Bands(threshold)

        def pairs_of(columns):
            key = columns[0]
            cut = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            many = ends - starts > 1
            found, n = [], 0
            for pairs in _run_pairs(columns, starts[many], ends[many], threshold, bands):
                found.append(pairs)
                n += len(pairs[0])
                if n > 200_000:
                    yield found
                    found, n = [], 0
            if n:
                yield found

        def out(columns):
            for found in pairs_of(columns):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in range(3)], schema=schema)

        for b in parts:
            columns = [np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held)]
            if not len(columns[0]):
                continue
            last = int(np.searchsorted(columns[0], columns[0][-1], side="left"))
            if last:
                yield from out([c[:last] for c in columns])
            held = [c[last:] for c in columns]
        if len(held[0]):
            yield from out(held)

    placed = met.repartition("key").sortWithinPartitions("key")
    return placed.mapInArrow(pair, "a long, b long, need int").groupBy("a", "b", "need").count().where("count >= need").select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the candidates that reach the threshold on their sets."""
    touched = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-touched")
    sets = nodes.join(maybe_broadcast(touched, touched.count(), 24), "node", "left_semi")
    sets = materialize(sets.select("node", "members"), "near-members")

    @F.pandas_udf("double")
    def jaccard(left: pd.Series, right: pd.Series) -> pd.Series:
        out = np.empty(len(left))
        for i, (x, y) in enumerate(zip(left, right)):
            x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            both = np.sort(np.concatenate([x, y]), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            out[i] = shared / (len(both) - shared)
        return pd.Series(out, index=left.index)

    left = sets.select(F.col("node").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("right"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", jaccard.asNondeterministic()("left", "right").alias("jaccard"))
    return scored.where(F.col("jaccard") >= threshold - 1e-12)


def node_join(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, roots, nodes): the node of each row with a non-empty set as (id, row, node), the component (node, root) of every
    node that is joined to another, and (node, members).

    Two rounds: a few pairs for each node find most of every family; then all keys are joined, some bands at a time, but only
    between nodes that aren't in one component yet, so no family is expanded into its pairs and no link between components is
    lost.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("the threshold must be above 0.5 and at most 1")
    sets = materialize(_sets(docs, n, id_col, text_col), "near-sets")
    rows = sets.select("id", "row", "node")
    place = F.struct("id", "row")
    repeated = sets.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    repeated = materialize(repeated.select(F.col("node").alias("again"), "first"), "near-repeated")
    first = F.col("again").isNull() | (F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.row") == F.col("row")))
    nodes = sets.join(maybe_broadcast(repeated, repeated.count(), 48), F.col("node") == F.col("again"), "left").where(first).select("node", "size", "members")
    close = materialize(_verified(materialize(_hub_pairs(nodes.withColumn("label", F.col("node")), threshold), "near-hubs"), nodes, threshold), "near-close")
    known = components(close)
    labelled = nodes.join(maybe_broadcast(known, known.count(), 40), "node", "left").select("node", F.coalesce("root", "node").alias("label"), "size", "members")
    count, passes = _passes(nodes, threshold)
    rarity = docs.sparkSession.sparkContext.broadcast(_rarity(nodes, count))
    pairs = None
    for probes in passes:
        met = _met(labelled, threshold, rarity, probes)
        found = materialize(_candidates(met, threshold), "near-pairs")
        discard(met)
        pairs = found if pairs is None else pairs.unionByName(found)
    edges = materialize(_verified(pairs, nodes, threshold), "near-edges")
    return rows, components(close.unionByName(edges)), nodes


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge (a, b): the smallest node of its connected component.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each written out, until nothing changes.
    """
    e = materialize(edges.select("a", "b").where("a <> b").distinct(), "cc")

    def state(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    seen = state(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        e = materialize(small.distinct(), "cc")
        now = state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates (connected by pairs of Jaccard >= threshold), columns unchanged.

    The row with the smallest id stays; null ids come last; ties go to the smallest hash over all columns, and of rows
    equal in every column one stays. Rows without a word (null, empty or punctuation-only text) are near nothing and all
    stay. Texts of any length are compared whole. An empty table gives an empty table. Extra columns of any name pass through.
    """
    rows, roots, _ = node_join(docs, threshold, n, id_col, text_col)
    labelled = rows.join(roots, "node", "left").select("id", "row", F.coalesce("root", "node").alias("root"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("w")
    winners = labelled.groupBy("root").agg(least, F.count(F.lit(1)).alias("n")).where("n > 1").select("root", F.col("w.id").alias("wid"), F.col("w.row").alias("wrow"))
    return keep_winners(docs, labelled.join(winners, "root").select("id", "row", "wid", "wrow"), id_col)


def _links(roots: DataFrame, nodes: DataFrame, copies: DataFrame, threshold: float) -> DataFrame:
    """(node, links): for every joined node the documents of other nodes that reach the threshold with it.

    The nodes of a component are hashed into tiles of about ``TILE``; each pair of tiles is compared by one product of
    incidence matrices, and only sums for each node leave the task.
    """
    tiles = roots.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    small = roots.join(tiles, "root").join(copies, "node").select("node", "root", "tiles", "n")
    small = materialize(small, "near-joined")
    own = nodes.join(maybe_broadcast(small, small.count(), 56), "node").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    placed = own.select("root", "tile", "node", "n", "members", other).select("root", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "tile", "node", "n", "members")

    def count(table: pa.Table) -> pa.Table:
        tile, x, y = table.column("tile").to_numpy(), table.column("x")[0].as_py(), table.column("y")[0].as_py()
        sets = [np.frombuffer(m.as_buffer(), np.uint32) for c in table.column("members").chunks for m in c]
        sizes, n = np.array([len(m) for m in sets]), table.column("n").to_numpy()
        left, right = np.flatnonzero(tile == x), np.flatnonzero(tile == y)
        shared = np.zeros((len(left), len(right)), np.float32)
        if len(left) and len(right):
            word, code = np.unique(np.concatenate(sets), return_inverse=True)
            owner, place = np.repeat(np.arange(len(sets)), sizes), np.empty(len(sets), np.int64)
            place[left] = np.arange(len(left))
            for at in range(0, len(word), 2048):
                some = (code >= at) & (code < at + 2048)
                full = np.zeros((len(sets), min(2048, len(word) - at)), np.float32)
                full[owner[some], code[some] - at] = 1
                shared += full[left] @ full[right].T
        union = sizes[left][:, None] + sizes[right][None, :] - shared
        near = shared / union >= threshold - 1e-12
        if x == y:
            np.fill_diagonal(near, False)
        out = np.zeros(len(sets), np.int64)
        np.add.at(out, left, near @ n[right])
        if x != y:
            np.add.at(out, right, near.T @ n[left])
        return pa.Table.from_arrays([table.column("node"), pa.array(out)], names=["node", "links"])

    parts = placed.groupBy("root", "x", "y").applyInArrow(count, "node long, links long")
    return parts.groupBy("node").agg(F.sum("links").alias("links"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The Jaccard join as (id, class_id, n_links), one row for each document.

    Two documents are linked if the Jaccard index of their sets of word n-grams (by 32-bit hashes) is at least the
    threshold. ``class_id`` is the smallest id that a document is connected to over links, its own if it has none, and
    ``n_links`` the number of other documents that it is linked to, equal ones too. Rows without an id are left out. Rows that
    share an id are one document each, and the id has a row for each that differs. Rows equal in every column are one
    document. A text without a word (null, empty, punctuation) has no link. Texts of any length are compared whole. An empty
    table gives no rows. Other columns take no part, except that they tell rows apart.
    """
    docs = docs.where(q(id_col).isNotNull())
    rows, roots, nodes = node_join(docs, threshold, n, id_col, text_col)
    rows = rows.distinct()
    copies = materialize(rows.groupBy("node").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")), "near-copies")
    roots = materialize(roots, "near-roots")
    links = materialize(_links(roots, nodes, copies.select("node", "n"), threshold), "near-links")
    least = roots.join(copies, "node").groupBy("root").agg(F.min("head").alias("least"))
    found = roots.join(least, "root").join(links, "node", "left").select("node", "least", "links")
    known = copies.join(found, "node", "left").select("node", F.coalesce("least", "head").alias("least"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    own = docs.select(q(id_col).alias("id"), row_hash(docs).alias("row")).distinct()
    joined = own.join(rows, ["id", "row"], "left").join(known, "node", "left")
    return joined.select(F.col("id").alias(id_col), F.coalesce("least", "id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS s FROM documents),
u AS (SELECT doc_id, unnest(s) AS w, len(s) AS n FROM t),
sets AS (SELECT doc_id, n, md5(string_agg(w, ' ' ORDER BY w)) AS h FROM u GROUP BY ALL),
heads AS (SELECT h, min(doc_id) AS head, count(*) AS copies FROM sets GROUP BY h),
v AS (SELECT doc_id, w, n FROM u JOIN heads ON doc_id = head),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k, any_value(x.n) AS m, any_value(y.n) AS n
  FROM v x JOIN v y ON x.w = y.w AND x.doc_id < y.doc_id AND least(x.n, y.n) >= {THRESHOLD} * greatest(x.n, y.n) GROUP BY 1, 2),
near AS (SELECT a, b FROM shared WHERE k >= {THRESHOLD} * (m + n - k)),
e AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT head AS id, head AS other FROM heads UNION SELECT id, b FROM reach JOIN e ON other = a),
least AS (SELECT id, min(other) AS class_id FROM reach GROUP BY id),
linked AS (SELECT a AS id, sum(copies) AS links FROM e JOIN heads ON b = head GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, CAST(coalesce(copies - 1, 0) + coalesce(links, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN sets USING (doc_id) LEFT JOIN heads USING (h) LEFT JOIN least ON least.id = head LEFT JOIN linked ON linked.id = head
"""
