"""What both passage operators share: which places can hold a repeated window of words, and the spans from confirmed ones.

A window is ``length`` consecutive words. Every window has an anchor, the k-gram of least hash inside it, which depends on
the window's words alone: equal windows have equal anchors wherever they stand. So only windows whose anchor occurs twice
can repeat. One scan writes a short row for every run of windows that share an anchor: the anchor, a hash of the words under
the run (its content), and hashes of the anchor with as many words to its left, or right, as every window has on one side
or the other. Words are needed of few runs only:

* A content that stands at two places repeats as a whole.
* Two contents of one anchor share a window only if they share the words to the left or to the right of it. Of the contents
  that do, one place each gives its words (a segment); windows are confirmed among the segments of one anchor.

Words are separated by ASCII white space. Rows equal in every column are one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, materialize, ngram_hashes, q, row_hash, sieved, span_hashes, window_min

LENGTH, GRAM = 50, 8


class ByteHashes(WordHashes):
    """The same for words that are bytes already."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= self.limit:
            self.clear()
        self[word] = h
        return h


def word_hashes(text: str | None, hashes: ByteHashes) -> np.ndarray:
    return hashes.of((text or "").encode("utf-8", "surrogatepass").split())


def anchor_places(words: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all k-grams, place of the anchor of every window): the gram of least hash, the leftmost of equal ones."""
    grams = ngram_hashes(words, gram)
    low = np.uint64((1 << 20) - 1)
    least = window_min((grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low), length - gram + 1)
    window = np.arange(len(least), dtype=np.uint64)
    return grams.view(np.int64), (window + (((least & low) - window) & low)).astype(np.int64)


def anchor_runs(words: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of windows that share one anchor at one place, in order; none is longer than a window. Columns as in ``places``."""
    grams, place = anchor_places(words, length, gram)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(place)), bool), place[1:] != place[:-1]]))
    count = np.diff(np.concatenate([first, [len(place)]]))
    at = place[first]
    side = (length - gram + 1) // 2  # words that a window has on one side of its anchor at least
    end = first + count + length - 1
    left, right = at - first >= side, end - at - gram >= side
    whole = span_hashes(words, first, end)
    lefts, rights = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    lefts[left] = span_hashes(words, at[left] - side, at[left] + gram) >> 32 | 1
    rights[right] = span_hashes(words, at[right], at[right] + gram + side) >> 32 | 1
    return {"h": grams[at], "c": whole, "l": lefts, "r": rights, "first": first, "count": count, "o": at - first}


def scanned(docs: DataFrame, text_col: str, length: int, gram: int) -> DataFrame:
    """(h, c, l, r, d, first, count, o) of every run of every document; d is the hash of the whole row, o the place of the anchor
    in the run. l and r are 0 where a side is too short to matter."""
    kinds = {"h": pa.int64(), "c": pa.int64(), "l": pa.int32(), "r": pa.int32(), "d": pa.int64(), "first": pa.int32(), "count": pa.int16(), "o": pa.int16()}
    schema = pa.schema(list(kinds.items()))

    def build(parts):
        hashes = ByteHashes()
        out: list[dict] = []
        n = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]).astype(kind.to_pandas_dtype()), kind) for k, kind in kinds.items()], schema=schema)

        for b in parts:
            for d, text in zip(b.column("d").to_pylist(), b.column("text")):
                runs = anchor_runs(word_hashes(text.as_py(), hashes), length, gram)
                if k := len(runs["h"]):
                    out.append(runs | {"d": np.full(k, d, np.int64)})
                    n += k
                if n > 100_000:
                    yield batch()
                    out, n = [], 0
        if n:
            yield batch()

    source = docs.select(row_hash(docs).alias("d"), q(text_col).alias("text")).where(F.col("text").isNotNull())
    return source.mapInArrow(build, "h long, c long, l int, r int, d long, first int, count short, o short")


def recurring(docs: DataFrame, text_col: str, length: int, gram: int) -> DataFrame:
    """(h, c, d, first, count, many, head, asked, skip, take): the runs of anchors that occur twice. many: the content stands at two places,
    so all its windows repeat. head: this is the first place of the content. asked: it is to give the content's words, since
    those may share ``take`` windows behind the first ``skip`` with another. Written out. All is decided in one exchange of the short rows, by windows that
    spill."""
    place = F.struct("d", "first")
    by = {k: Window.partitionBy(*k) for k in (("h",), ("h", "c"), ("h", "l"), ("h", "r"))}
    found = materialize(scanned(docs, text_col, length, gram), "passage-runs")
    # equal rows have equal places, so a copy of the row doesn't make an anchor recur, and is harmless in what follows
    found = found.withColumn("one", F.min(place).over(by["h",])).withColumn("other", F.max(place).over(by["h",])).where("one <> other").drop("one", "other")
    found = found.withColumn("lo", F.min(place).over(by["h", "c"])).withColumn("many", F.max(place).over(by["h", "c"]) != F.col("lo"))
    for side in ("l", "r"):
        over = by["h", side]
        found = found.withColumn(f"s{side}", (F.col(side) != 0) & (F.min("c").over(over) != F.max("c").over(over)))
    # a shared window has the left side of its anchor, so it begins no later than that, or the right side, so it ends no earlier
    side = (length - gram + 1) // 2
    skip = F.when(F.col("sl"), F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("o") + (gram + side - length)))
    take = F.when(F.col("sr"), F.col("count")).otherwise(F.least(F.col("count"), F.col("o") - (side - 1))) - skip
    head = (F.col("lo.d") == F.col("d")) & (F.col("lo.first") == F.col("first"))
    return materialize(found.select("h", "c", "d", "first", "count", "many", head.alias("head"), (head & (F.col("sl") | F.col("sr"))).alias("asked"), skip.cast("short").alias("skip"), take.cast("short").alias("take")), "passage-places")


def texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, id, text) of the documents in ``wanted`` (d, distinct), and of few others."""
    source = docs.select(row_hash(docs).alias("d"), q(id_col).alias("id"), q(text_col).alias("text")).where(F.col("text").isNotNull())
    return sieved(source, "d", wanted, wanted.count())


def segments(docs: DataFrame, places: DataFrame, text_col: str, length: int) -> DataFrame:
    """(c, h, words, many, skip): the 32-bit hashes of the words of the windows that every content was asked for, behind its
    first ``skip``; copies of a row may repeat it."""
    schema = pa.schema([("c", pa.int64()), ("h", pa.int64()), ("words", pa.binary()), ("many", pa.bool_()), ("skip", pa.int32())])

    def build(parts):
        hashes, last = ByteHashes(), None
        for b in parts:
            out = {f.name: [] for f in schema}
            for d, text, runs in zip(b.column("d").to_pylist(), b.column("text"), b.column("runs").to_pylist()):
                if d == last:  # copies of a row follow each other where the join has sorted them
                    continue
                last = d
                words = (word_hashes(text.as_py(), hashes) >> np.uint64(32)).astype(np.uint32)
                for r in runs:
                    out["c"].append(r["c"])
                    out["h"].append(r["h"])
                    start = r["first"] + r["skip"]
                    out["words"].append(words[start : start + r["take"] + length - 1].tobytes())
                    out["skip"].append(r["skip"])
                    out["many"].append(r["many"])
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    wanted = materialize(places.where("asked").groupBy("d").agg(F.collect_set(F.struct("c", "h", "first", "skip", "take", "many")).alias("runs")), "passage-asked")
    source = texts(docs, wanted.select("d"), text_col, text_col).select("d", "text")
    return source.join(wanted, "d").mapInArrow(build, "c long, h long, words binary, many boolean, skip int")


def as_ranges(starts: np.ndarray, skip: int = 0) -> list[dict]:
    """Sorted distinct window starts, moved by ``skip``, as runs of consecutive ones: [{a, b}], b exclusive."""
    if not len(starts):
        return []
    starts = starts + skip
    cut = np.flatnonzero(np.diff(starts) > 1) + 1
    return [{"a": int(x[0]), "b": int(x[-1]) + 1} for x in np.split(starts, cut)]


def located(places: DataFrame, ranges: DataFrame) -> DataFrame:
    """(d, windows): every document's confirmed windows as sorted disjoint ranges: of contents that stand at two places all,
    of the others the ``ranges`` (c, ranges) confirmed in them."""
    whole = places.where("many").select("d", F.struct(F.col("first").alias("a"), (F.col("first") + F.col("count")).alias("b")).alias("r"))
    parts = places.where(~F.col("many")).select("c", "d", "first").join(ranges, "c").select("d", "first", F.explode("ranges").alias("r"))
    parts = parts.select("d", F.struct((F.col("first") + F.col("r.a")).alias("a"), (F.col("first") + F.col("r.b")).alias("b")).alias("r"))
    return whole.unionByName(parts).groupBy("d").agg(F.array_sort(F.collect_set("r")).alias("rs")).select("d", merged("rs", 0).alias("windows"))


def merged(ranges: str, reach: int):
    """Sorted ranges (a, b), none of which lies inside another, joined where the next begins at most ``reach`` after the end of the
    one before."""

    def one(all_):
        opens = F.filter(all_, lambda r, i: (i == 0) | (r["a"] > F.get(all_, i - 1)["b"] + reach))
        closes = F.filter(all_, lambda r, i: (i == F.size(all_) - 1) | (F.get(all_, i + 1)["a"] > r["b"] + reach))
        return F.zip_with(opens, closes, lambda o, c: F.struct(o["a"].alias("a"), c["b"].alias("b")))

    return F.transform(F.array(F.col(ranges)), one)[0]  # bound by a lambda, so what makes the array is computed once


def spans(docs: DataFrame, windows: DataFrame, length: int, id_col: str) -> DataFrame:
    """(id, start_word, n_words): the maximal runs of words that lie in confirmed windows."""
    ids = docs.select(row_hash(docs).alias("d"), q(id_col).alias("id"))
    joined = ids.join(windows, "d").dropDuplicates(["d"]).select("id", F.explode(merged("windows", length - 1)).alias("r"))
    return joined.select(F.col("id").alias(id_col), F.col("r.a").alias("start_word"), (F.col("r.b") - F.col("r.a") + (length - 1)).alias("n_words"))


def spans_sql(length: int) -> str:
    return f"""
WITH t AS (SELECT row_number() OVER () AS d, doc_id, w FROM (SELECT DISTINCT doc_id, regexp_extract_all(text, '\\S+') AS w, lang, source, n_chars FROM documents)),
n AS (SELECT d, unnest(range(len(w) - {length} + 1)) AS p FROM t WHERE len(w) >= {length}),
v AS (SELECT d, doc_id, p, md5(array_to_string(w[p + 1 : p + {length}], ' ')) AS k FROM n JOIN t USING (d)),
r AS (SELECT d, doc_id, p FROM v WHERE k IN (SELECT k FROM v GROUP BY k HAVING count(*) > 1)),
g AS (SELECT *, coalesce(p - lag(p) OVER (PARTITION BY d ORDER BY p) > {length}, true) AS new FROM r),
s AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY d ORDER BY p) AS run FROM g)
SELECT doc_id, CAST(min(p) AS INT) AS start_word, CAST(max(p) - min(p) + {length} AS INT) AS n_words FROM s GROUP BY d, doc_id, run
"""
