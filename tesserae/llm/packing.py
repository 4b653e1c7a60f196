"""Best-fit packing by a configuration linear program over the length histogram.

Documents are cut into pieces of at most ``capacity`` tokens. The driver sees only the histogram of rounded piece lengths
(at most ``classes`` numbers, whatever the corpus): it solves the covering program "choose multiplicities of bin
configurations so that every length class is covered" by multiplicative weights, each round pricing the best
configuration with an unbounded-knapsack dynamic program; rounds the solution down; and packs the bounded rest by best
fit decreasing over counts. A piece then finds its bin by arithmetic: its rank inside its length class selects a
configuration copy, so only (doc_id, length) rows are shuffled, evenly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, q

CAPACITY, CLASSES = 2048, 256


def price(weights: np.ndarray, classes: int) -> tuple[float, np.ndarray]:
    """Knapsack: the multiset of sizes 1..classes (weights[s-1] each) of total size <= classes with most weight."""
    best = np.zeros(classes + 1)
    took = np.zeros(classes + 1, np.int64)
    for room in range(1, classes + 1):
        values = best[room - 1 :: -1][:room] + weights[:room]  # size s leaves room - s
        s = int(values.argmax())
        if values[s] > best[room - 1]:
            best[room], took[room] = values[s], s + 1
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(classes, np.int64), classes
    while room:
        if took[room]:
            counts[took[room] - 1] += 1
            room -= int(took[room])
        else:
            room -= 1
    return float(best[classes]), counts


def solve(demand: np.ndarray, rounds: int = 400, epsilon: float = 0.08) -> list[tuple[np.ndarray, float]]:
    """Fractional cover of ``demand`` (pieces by size class) by configurations: (counts by class, multiplicity) pairs.

    Multiplicative weights for covering: each round prices a configuration with the current class weights, uses it until
    it has served a share of the class it serves fastest, and lowers the weights of the classes that it served.
    """
    classes = len(demand)
    need = demand.astype(float)
    present = need > 0
    found: dict[bytes, list] = {}
    if not present.any():
        return []
    log_w = np.where(present, 0.0, -np.inf)
    covered = np.zeros(classes)
    for _ in range(rounds):
        w = np.exp(log_w - log_w[present].max())
        w = np.where(present, w / np.maximum(need, 1), 0)
        _, counts = price(w / w.max(), classes)
        used = counts > 0
        if not used.any():
            break
        step = float((need[used] / counts[used]).min())  # the most copies of which none is wasted
        gain = counts * step / np.maximum(need, 1)
        log_w = np.where(present, log_w - epsilon * gain, -np.inf)
        covered += counts * step
        entry = found.setdefault(counts.tobytes(), [counts, 0.0])
        entry[1] += step
    short = np.where(present, covered / np.maximum(need, 1), np.inf).min()
    if short <= 0:
        scale = 1 / (covered / np.maximum(need, 1)).max()
    else:
        scale = 1 / short
    return [(c, x * scale) for c, x in found.values()]


def best_fit_decreasing(counts: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Best fit decreasing of counts by size class into bins of size len(counts); equal bins are kept as one entry."""
    classes = len(counts)
    bins: dict[bytes, list] = {}
    by_room: dict[int, dict[bytes, list]] = {}
    for size in range(classes, 0, -1):
        left = int(counts[size - 1])
        while left:
            room = min((r for r in by_room if r >= size and by_room[r]), default=None)
            if room is None:
                fit = max(1, classes // size)
                full, rest = divmod(left, fit)
                for take, n in ((fit, full), (rest, 1 if rest else 0)):
                    if n:
                        c = np.zeros(classes, np.int64)
                        c[size - 1] = take
                        by_room.setdefault(classes - take * size, {}).setdefault(c.tobytes(), [c, 0])[1] += n
                left = 0
            else:
                key, (c, n) = by_room[room].popitem()
                use = min(n, left)
                if n > use:
                    by_room[room][key] = [c, n - use]
                d = c.copy()
                d[size - 1] += 1
                by_room.setdefault(room - size, {}).setdefault(d.tobytes(), [d, 0])[1] += use
                left -= use
    for group in by_room.values():
        for key, (c, n) in group.items():
            bins.setdefault(key, [c, 0])[1] += n
    return [(c, n) for c, n in bins.values()]


def plan(demand: np.ndarray, **options) -> list[tuple[np.ndarray, int]]:
    """Whole configurations that serve ``demand`` exactly: (counts by class, copies). Their number doesn't grow with it."""
    left, chosen = demand.astype(np.int64).copy(), {}
    for counts, x in sorted(solve(demand, **options), key=lambda cx: -cx[1]):
        used = counts > 0
        n = min(int(x), int((left[used] // counts[used]).min()))
        if n > 0:
            left -= counts * n
            chosen.setdefault(counts.tobytes(), [counts, 0])[1] += n
    for counts, n in best_fit_decreasing(left):
        chosen.setdefault(counts.tobytes(), [counts, 0])[1] += n
    return [(c, n) for c, n in chosen.values()]


def slots(chosen: list[tuple[np.ndarray, int]], classes: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By class: ends of the rank ranges, pieces a copy, first bin, and the offset of the class inside the configuration."""
    table: dict[int, list] = {}
    first = 0
    for counts, n in chosen:
        offset = 0
        for size in np.flatnonzero(counts)[::-1] + 1:
            each = int(counts[size - 1])
            table.setdefault(int(size), []).append((each * n, each, first, offset))
            offset += each
        first += n
    return {s: (np.cumsum([r[0] for r in rows]), *(np.array([r[i] for r in rows]) for i in (1, 2, 3))) for s, rows in table.items()}


def token_count(text):
    """Tokens of a text: runs of other than ASCII white space. Null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def pack(docs: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, id_col: str = "doc_id", text_col: str = "text", lengths=None, rounds: int = 400) -> DataFrame:
    """One row for each piece: id, piece (0, 1, ...), start and n_tokens inside the document, bin, slot inside the bin.

    A document longer than ``capacity`` gives full pieces, each a bin of its own, and a rest. Every row of ``docs`` counts,
    repeated ids too (they are packed one by one); documents without a token (null, empty or blank text) give one piece of
    0 tokens, which takes the least class, so no document is lost. Lengths are rounded up to capacity / classes tokens, so
    a bin never holds more than ``capacity``. An empty table gives an empty result. ``lengths`` is a column with the token
    count, by default white-space tokens of the whole text. Other columns are not carried.
    """
    if capacity % classes:
        raise ValueError("capacity must be a multiple of classes")
    grain = capacity // classes
    length = token_count(q(text_col)) if lengths is None else lengths
    base = docs.select(q(id_col).alias("id"), F.greatest(length.cast("long"), F.lit(0)).alias("len"))
    pieces = base.select("id", "len", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("len") / capacity) - 1, F.lit(0)).cast("int"))).alias("piece"))
    pieces = pieces.select("id", "piece", (F.col("piece") * F.lit(capacity).cast("long")).alias("start"), F.least(F.col("len") - F.col("piece") * capacity, F.lit(capacity)).alias("n_tokens"))
    size = F.greatest(F.ceil(F.col("n_tokens") / grain), F.lit(1)).cast("int")
    # salted classes: a class of any size is ranked by many tasks; offsets of the salts are added on the way
    table = materialize(pieces.withColumn("size", size).withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(64)).cast("int")), "pack-pieces")
    held = table.groupBy("size", "salt").count().toPandas()  # classes x 64 rows at most
    demand = np.zeros(classes, np.int64)
    np.add.at(demand, held["size"].to_numpy(int) - 1, held["count"].to_numpy(np.int64))
    where = slots(plan(demand, rounds=rounds), classes)
    held = held.sort_values(["size", "salt"])
    before = held.groupby("size")["count"].cumsum() - held["count"]
    starts = np.zeros((classes + 1, 64), np.int64)
    starts[held["size"].to_numpy(int), held["salt"].to_numpy(int)] = before.to_numpy(np.int64)
    rank = F.row_number().over(Window.partitionBy("size", "salt").orderBy(F.col("id").asc_nulls_first(), "piece", "n_tokens")) - 1

    @F.pandas_udf("bin long, slot int")
    def place(sizes: pd.Series, salts: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        s = sizes.to_numpy(np.int64)
        k = ranks.to_numpy(np.int64) + starts[s, salts.to_numpy(np.int64)]
        out_bin, out_slot = np.zeros(len(s), np.int64), np.zeros(len(s), np.int32)
        for v in np.unique(s):
            at = np.flatnonzero(s == v)
            ends, each, first, offset = where[int(v)]
            row = np.searchsorted(ends, k[at], side="right")
            inside = k[at] - np.where(row > 0, ends[row - 1], 0)
            out_bin[at] = first[row] + inside // each[row]
            out_slot[at] = offset[row] + inside % each[row]
        return pd.DataFrame({"bin": out_bin, "slot": out_slot})

    placed = table.withColumn("rank", rank).withColumn("place", place("size", "salt", "rank"))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "n_tokens", F.col("place.bin").alias("bin"), F.col("place.slot").alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
