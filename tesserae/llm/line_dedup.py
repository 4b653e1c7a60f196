"""Line dedup by a deletion-neighbourhood join.

Two lines within one edit (a character inserted, deleted or replaced) share a variant: each line itself and each line
with one character deleted. All variants are emitted as 64-bit keys, equal keys are joined, candidates are verified by
edit distance, and of the occurrences that match the earliest stays.

Variants are many, so two exact reductions come first. Equal lines are one row. And a single edit leaves the first or
the last half of a line untouched, so only lines that share such a half with another line of nearly the same length can
have a partner; all other lines emit nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, mix64, q, row_hash

EDITS, LEAST_CHARS = 1, 12


def variants(line: str) -> np.ndarray:
    """Signed 64-bit keys of the line and of each line with one character deleted, distinct."""
    c = mix64(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    n = len(c)
    power = _powers(n)
    left = np.zeros(n + 1, np.uint64)  # left[i]: hash of the first i characters, as sum of c[j] * B**j
    np.cumsum(c * power, out=left[1:])
    whole = left[n]
    # behind the deleted character every position is one lower: divide by B
    cut = left[:-1] + (whole - left[1:]) * _INVERSE
    keys = np.concatenate([mix64(np.array([whole]) + np.uint64(n)), mix64(cut + np.uint64(n - 1))])
    return np.unique(keys.view(np.int64))


_B = 0xD1342543DE82EF95
_INVERSE = np.uint64(pow(_B, -1, 1 << 64))
_table = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _table
    while len(_table) < n:
        _table = np.concatenate([_table, _table * np.uint64(pow(_B, len(_table), 1 << 64))])
    return _table[:n]


def split_lines(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(id, row, at, line, h): the lines of every document that are long enough, with their places, outer blanks trimmed."""
    lines = F.posexplode(F.split(q(text_col), "\n"))
    raw = docs.select(q(id_col).alias("id"), row_hash(docs).alias("row"), lines.alias("at", "raw"))
    trimmed = raw.select("id", "row", "at", F.trim(F.translate("raw", "\r\t", "  ")).alias("line"))
    return trimmed.where(F.length("line") >= least_chars).withColumn("h", F.xxhash64("line"))


def half_keys():
    """Keys of the halves of a line of n characters, cut for a partner of n or n + 1 characters and for one of n - 1."""
    n = F.length("line")
    sizes = [F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")]
    return F.array_distinct(F.array(*[F.xxhash64(side("line", size), F.lit(kind), size) for size in sizes for kind, side in (("head", F.left), ("tail", F.right))]))


def near_lines(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of lines, by hash, within one edit of each other. ``lines``: distinct h with keys; ``texts``: (h, line)."""
    parts = lines.select("h", F.explode("keys").alias("key")).repartition("key")  # one exchange for both uses
    shared = parts.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("key")
    hopeful = materialize(parts.join(shared, "key", "left_semi").select("h").distinct(), "line-hopeful")
    found = texts.join(maybe_broadcast(hopeful, hopeful.count(), 24), "h", "left_semi")
    chosen = materialize(found.groupBy("h").agg(F.first("line").alias("line")), "line-chosen")

    def emit(parts):
        for b in parts:
            if not b.num_rows:
                continue
            keys = [variants(x) for x in b.column("line").to_pylist()]
            ids = np.repeat(b.column("h").to_numpy(), [len(k) for k in keys])
            keys = np.concatenate(keys)
            for at in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_pydict({"v": keys[at : at + 200_000], "h": ids[at : at + 200_000]})

    emitted = chosen.mapInArrow(emit, "v long, h long").repartition("v")
    met = emitted.groupBy("v").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("v")
    lists = emitted.join(met, "v", "left_semi").groupBy("v").agg(F.array_sort(F.collect_set("h")).alias("hs")).select("hs").distinct()
    pairs = lists.select("hs", F.explode("hs").alias("a")).select("a", F.explode("hs").alias("b")).where("a < b").distinct()
    near = pairs.join(chosen.toDF("a", "x"), "a").join(chosen.toDF("b", "y"), "b").where(F.levenshtein("x", "y", EDITS).between(0, EDITS))
    return near.select("a", "b")


def line_dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated lines removed: id, text, n_lines, n_dropped.

    A line goes when an earlier line of the corpus - by id, then by the hash of the row, then by place - is equal to it or
    within one edit, whether or not that earlier line stays itself. Lines are compared with outer blanks trimmed; lines
    of fewer than ``least_chars`` characters, empty ones too, always stay and drop nothing. Null ids come last. A null
    text gives a null text and no lines. Rows that are equal in every column count as one document and are returned
    alike. Lines that stay are unchanged; a document whose lines all go has an empty text. Lines of any length are compared
    whole; an empty table gives an empty table. Other columns are not carried, except that they tell rows apart. Lines that share
    a variant differ in one place of it, so no variant has more lines than its length times the characters in use.
    """
    split = split_lines(docs, id_col, text_col, least_chars)
    rows = materialize(split.select("id", "row", "at", "h", half_keys().alias("keys")), "line-rows")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "at")
    lines = materialize(rows.groupBy("h").agg(F.min(place).alias("first"), F.first("keys").alias("keys")), "line-distinct")
    near = materialize(near_lines(lines, split.select("h", "line")), "line-near")
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    firsts = lines.select("h", "first")
    # the earliest occurrence among a line and the lines near it
    best = both.join(firsts.toDF("b", "other"), "b").groupBy("a").agg(F.min("other").alias("other"))
    earliest = firsts.join(best.withColumnRenamed("a", "h"), "h", "left").select("h", F.least("first", "other").alias("e"))
    dropped = rows.select("h", "id", "row", "at").join(earliest, "h").where(place > F.col("e"))
    gone = materialize(dropped.groupBy(F.col("id").alias("gid"), F.col("row").alias("grow")).agg(F.collect_set("at").alias("gone")), "line-gone")
    size = gone.agg(F.count(F.lit(1)), F.sum(F.size("gone"))).first()
    base = docs.select(q(id_col).alias("id"), row_hash(docs).alias("row"), q(text_col).alias("text"))
    joined = base.join(maybe_broadcast(gone, size[0] * 64 + (size[1] or 0) * 8, 1), F.col("id").eqNullSafe(F.col("gid")) & (F.col("row") == F.col("grow")), "left")
    parts = F.split("text", "\n")
    numbered = F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    kept = F.filter(numbered, lambda s: ~F.array_contains("gone", s["i"]))
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept["x"], "\n")).alias("text"),
        F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same rule with its own reductions, so that whole tables can be compared: lines meet by numbers and hashed variants,
#: only those that share a half with another line emit any, and a pair is verified once.
SQL = f"""
WITH raw AS (SELECT doc_id, unnest(range(len(p))) AS i, unnest(p) AS r FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
l AS (SELECT doc_id, i, r, trim(translate(r, chr(13) || chr(9), '  '), ' ') AS t FROM raw),
d AS MATERIALIZED (SELECT row_number() OVER () AS n, t, f FROM (SELECT t, min((doc_id, i)) AS f FROM l WHERE length(t) >= {LEAST_CHARS} GROUP BY t)),
h AS (SELECT n, unnest([hash(0, s, left(t, s)), hash(1, s, right(t, s))]) AS k FROM (SELECT n, t, CAST(unnest([length(t) // 2, (length(t) - 1) // 2]) AS INT) AS s FROM d)),
c AS MATERIALIZED (SELECT * FROM d WHERE n IN (SELECT n FROM h WHERE k IN (SELECT k FROM h GROUP BY k HAVING min(n) < max(n)))),
v AS MATERIALIZED (SELECT n, hash(t) AS k FROM c UNION
      SELECT n, hash(left(t, CAST(j AS INT)) || substr(t, CAST(j AS INT) + 2)) FROM (SELECT n, t, unnest(range(length(t))) AS j FROM c)),
p AS MATERIALIZED (SELECT DISTINCT x.n AS a, y.n AS b FROM v x JOIN v y ON x.k = y.k WHERE x.n < y.n),
g AS MATERIALIZED (SELECT x.n AS a, x.f AS af, y.n AS b, y.f AS bf FROM p JOIN c x ON a = x.n JOIN c y ON b = y.n WHERE levenshtein(x.t, y.t) <= {EDITS}),
e AS (SELECT t, min(f) AS f FROM (SELECT t, f FROM d UNION ALL SELECT t, bf FROM g JOIN d ON n = a UNION ALL SELECT t, af FROM g JOIN d ON n = b) GROUP BY t),
m AS (SELECT l.doc_id, l.i, l.r, coalesce((l.doc_id, l.i) > e.f, false) AS gone FROM l LEFT JOIN e ON l.t = e.t)
SELECT doc_id, coalesce(string_agg(r, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text,
  CAST(count(*) AS INT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS INT) AS n_dropped FROM m GROUP BY doc_id
"""
