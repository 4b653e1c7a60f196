"""Substring dedup by repeated-phrase automata.

1. Recurring passages are confirmed: windows of ``length`` words that occur twice (``passages``).
2. Every document's confirmed run is tiled by windows: those at which the anchor changes, which near copies share, and the
   two at the ends; no gap is as long as a window. The tiles are the phrases; a content's first place gives those inside it.
   Every anchor has one shard, anchors of one family of copies share it where that fits (copies mostly agree on the least of
   their confirmed anchors), and each shard is compiled to an Aho-Corasick automaton of bounded size.
3. Every document streams through the automata of all shards of its anchors: not whole, but with the stretches of words that
   such anchors govern. A phrase can't occur elsewhere, nor in another shard, so every occurrence is found, and no text is
   sent to a shard that can't match it. Phrases and stretches are cut in one pass over the texts. The phrases of a shard come
   first in the sort order of its partition, so documents stream through with one automaton in memory. Shards with many
   documents are sliced over several tasks.
"""

from __future__ import annotations

from bisect import bisect_right

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import passages
from .common import materialize, maybe_broadcast, ngram_hashes

#: Bytes of phrases in one automaton, which takes about a hundred times as much memory; documents in one slice of a shard.
SHARD_BYTES, SLICE_DOCS = 1 << 20, 512


def confirm(distinct: DataFrame, length: int) -> DataFrame:
    """(c, ranges): windows of contents of one place that occur at two places. All segments of an anchor that may share a window
    meet in one run of the sort order."""
    schema = pa.schema([("c", pa.int64()), ("ranges", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])

    def decide(group: list[tuple[int, bytes, bool, int]]):
        keys, owner, start = [], [], []
        for i, (_, words, many, _) in enumerate(group):
            w = ngram_hashes(np.frombuffer(words, np.uint32).astype(np.uint64), length)
            keys += [w, w] if many else [w]
            owner += [np.full(len(w), i)] * (1 + many)
            start += [np.arange(len(w))] * (1 + many)
        keys, owner, start = map(np.concatenate, (keys, owner, start))
        _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
        yes = counts[inverse] > 1
        for i in np.unique(owner[yes]).tolist():
            if not group[i][2]:
                yield group[i][0], passages.as_ranges(np.unique(start[yes & (owner == i)]), group[i][3])

    def build(parts):
        group, anchor, seen = [], None, set()
        out: dict[str, list] = {"c": [], "ranges": []}

        def flush():
            for c, ranges in decide(group) if len(group) > 1 else ():
                out["c"].append(c)
                out["ranges"].append(ranges)

        for b in parts:
            for c, h, words, many, skip in zip(*(b.column(x).to_pylist() for x in ("c", "h", "words", "many", "skip"))):
                if h != anchor:
                    flush()
                    group, anchor, seen = [], h, set()
                if c not in seen:
                    seen.add(c)
                    group.append((c, words, many, skip))
            yield pa.RecordBatch.from_pydict(out, schema=schema)
            out["c"], out["ranges"] = [], []
        flush()
        yield pa.RecordBatch.from_pydict(out, schema=schema)

    placed = distinct.repartition("h").sortWithinPartitions("h")
    return placed.mapInArrow(build, "c long, ranges array<struct<a:int,b:int>>")


def sharded(runs: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(h, shard, slices) of every anchor of the confirmed ``runs``. A family whose phrases may take more than ``shard_bytes`` is
    split over several shards; the documents of a shard over several slices."""
    own = runs.withColumn("family", F.min("h").over(Window.partitionBy("d")))
    about = 2 * 7 * length  # bytes of the phrases of a content, roughly
    anchors = materialize(own.groupBy("h").agg(F.min("family").alias("family"), F.sum(F.col("head").cast("int") * F.lit(about)).alias("bytes"), F.count(F.lit(1)).alias("n")), "phrase-anchors")
    families = materialize(anchors.groupBy("family").agg(F.sum("bytes").alias("bytes")), "phrase-families")
    rows, total = families.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    shards = max(1, -(-(total or 0) // shard_bytes))
    parts = families.select("family", F.greatest(F.lit(1), F.ceil(F.col("bytes") / shard_bytes)).alias("parts"))
    part = F.pmod(F.xxhash64("h"), F.col("parts"))
    placed = anchors.join(maybe_broadcast(parts, rows, 32), "family").withColumn("shard", F.pmod(F.xxhash64("family", part), F.lit(shards)).cast("int"))
    placed = materialize(placed.select("h", "shard", "n"), "phrase-shards")
    # a run has some 21 windows, a document in a slice some 16 runs
    slices = placed.groupBy("shard").agg(F.ceil(F.sum("n") / (16 * SLICE_DOCS)).cast("int").alias("slices"))
    return placed.select("h", "shard").join(maybe_broadcast(slices, shards, 16), "shard")


def cut(documents: DataFrame, length: int, gram: int) -> DataFrame:
    """(shard, slice, kind, d, start, text) of (d, text, runs, windows): phrases (kind 0) for every slice of their shard, and the
    stretches of the document (kind 1), neighbouring runs of a shard as one text."""
    kinds = {"shard": pa.int32(), "slice": pa.int32(), "kind": pa.int32(), "d": pa.int64(), "start": pa.int32(), "text": pa.string()}
    schema = pa.schema(list(kinds.items()))

    def build(parts):
        last_d, size = None, 0
        out: dict[str, list] = {k: [] for k in kinds}

        def put(*row):
            for column, value in zip(out.values(), row):
                column.append(value)

        for b in parts:
            for d, text, runs, ranges in zip(b.column("d").to_pylist(), b.column("text"), b.column("runs").to_pylist(), b.column("windows").to_pylist()):
                if d == last_d:  # copies of a row follow each other
                    continue
                last_d, words, open_ = d, text_words(text.as_py()), {}
                runs.sort(key=lambda r: r["first"])
                firsts = [r["first"] for r in runs]
                for r in ranges:
                    # the runs of a range follow each other without a gap
                    i, end = bisect_right(firsts, r["a"]) - 1, r["b"] - 1
                    points = [(r["a"], runs[i])] if runs[i]["head"] else []
                    while i + 1 < len(runs) and firsts[i + 1] < end:
                        i += 1
                        if runs[i]["head"]:
                            points.append((firsts[i], runs[i]))
                    points.append((end, runs[bisect_right(firsts, end) - 1]))
                    for p, run in dict(points).items():
                        phrase = " ".join(words[p : p + length])
                        size += len(phrase) * run["slices"]
                        for k in range(run["slices"]):
                            put(run["shard"], k, 0, 0, 0, phrase)
                for r in runs:
                    a, e = r["first"], r["first"] + r["count"] + length - 1
                    held = open_.get(r["shard"])
                    if held and a <= held[1]:
                        held[1] = e
                        continue
                    if held:
                        put(r["shard"], d % held[2], 1, d, held[0], " ".join(words[held[0] : held[1]]))
                    open_[r["shard"]] = [a, e, r["slices"]]
                for shard, held in open_.items():
                    put(shard, d % held[2], 1, d, held[0], " ".join(words[held[0] : held[1]]))
                size += 8 * len(words)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], schema=schema)
                    out, size = {k: [] for k in kinds}, 0
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], schema=schema)

    return documents.select("d", "text", "runs", "windows").mapInArrow(build, "shard int, slice int, kind int, d long, start int, text string")


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    """Over text of words joined by single spaces, with a space at both ends, so matches keep to whole words."""
    found = ahocorasick.Automaton()
    for p in phrases:
        found.add_word(f" {p} ", len(p) + 2)
    found.make_automaton()
    return found


def occurrences(text: str, phrases: ahocorasick.Automaton) -> np.ndarray:
    """First words of all occurrences of the phrases, sorted and distinct."""
    flat = f" {' '.join(text_words(text))} "
    starts = np.array([end - n + 1 for end, n in phrases.iter(flat)], np.int64)
    if not len(starts):
        return starts
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.unique(np.searchsorted(np.flatnonzero(points == 32), starts))


def text_words(text: str) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def stream(rows: DataFrame) -> DataFrame:
    """(d, rs): ranges of windows at which a phrase of a shard was found in its stretches. ``rows`` as ``cut`` gives them."""
    placed = rows.repartition("shard", "slice").sortWithinPartitions("shard", "slice", "kind")
    schema = pa.schema([("d", pa.int64()), ("rs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])

    def search(parts):
        at, held, machine = None, {}, None
        for b in parts:
            out = {"d": [], "rs": []}
            for shard, part, kind, d, start, text in zip(*(b.column(x).to_pylist() for x in ("shard", "slice", "kind", "d", "start", "text"))):
                if (shard, part) != at:
                    at, held, machine = (shard, part), {}, None
                if kind == 0:
                    held[text] = None
                    continue
                if machine is None:
                    machine, held = automaton(list(held)), {}
                found = occurrences(text, machine)
                if len(found):
                    out["d"].append(d)
                    out["rs"].append(passages.as_ranges(found + start))
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return placed.mapInArrow(search, "d long, rs array<struct<a:int,b:int>>")


def repeated_spans(docs: DataFrame, length: int = passages.LENGTH, gram: int = passages.GRAM, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, n_words): every maximal run of words covered by windows of ``length`` words that occur at two
    places of the corpus, in one document or in several; all occurrences are listed, the first too.

    Words are separated by ASCII white space and compared exactly. Texts that are null, empty or shorter than ``length``
    words have no span. Rows equal in every column are one document; rows that share an id but differ are two, and both
    report under that id. A null id is reported as null. Texts of any length are searched whole. An empty table gives no spans. Other columns take no part.
    """
    if not 1 <= gram <= length:
        raise ValueError("a gram must be of 1 to `length` words")
    places = passages.recurring(docs, text_col, length, gram)
    ranges = confirm(passages.segments(docs, places, text_col, length), length)
    kept = ["h", "d", "first", "count", "head"]
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("count").cast("int").alias("b"))).alias("ranges")
    runs = places.where("many").select(*kept, whole).unionByName(places.where(~F.col("many")).join(ranges, "c").select(*kept, "ranges"))
    runs = materialize(runs, "phrase-runs")
    known = runs.join(sharded(runs, length, shard_bytes), "h")
    moved = F.transform("ranges", lambda r: F.struct((F.col("first") + r["a"]).alias("a"), (F.col("first") + r["b"]).alias("b")))
    known = known.select("d", F.struct("first", "count", "head", "shard", "slices").alias("run"), moved.alias("at"))
    known = known.groupBy("d").agg(F.collect_set("run").alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("at")))).alias("at"))
    known = materialize(known.select("d", "runs", passages.merged("at", 0).alias("windows")), "phrase-documents")
    source = passages.texts(docs, known.select("d"), text_col, text_col).select("d", "text")
    hits = stream(cut(source.join(known, "d"), length, gram))
    windows = hits.select("d", F.explode("rs").alias("r")).groupBy("d").agg(F.array_sort(F.collect_set("r")).alias("rs"))
    return passages.spans(docs, windows.select("d", passages.merged("rs", 0).alias("windows")), length, id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = passages.spans_sql(passages.LENGTH)
