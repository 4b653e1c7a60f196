"""Suffix-array dedup by external induced sorting.

The corpus is cut into shards by content: all segments of one anchor (``passages``) are in one shard, so any two equal
windows meet. A shard is a sequence of 32-bit words with a unique separator behind every segment. It is sorted like this
(Bingmann, Fischer and Osipov, "Inducing suffix and LCP arrays in external memory", 2013):

1. Suffixes are of type S (smaller than the next one) or L. The substrings between leftmost S suffixes are sorted in
   runs on disk and named; unless all names differ, the sequence of names is sorted by recursion.
2. A scan upwards over the sorted leftmost S suffixes and a priority queue induces all L suffixes in order; a scan
   downwards over those and a second queue induces all S suffixes. A queue entry is a tuple (word, order of arrival,
   place, common prefix). Queues and lists keep a bounded number of tuples in memory and spill sorted runs to disk.
3. The common prefix of two induced neighbours is one more than the least common prefix between the suffixes that induced
   them. Values are capped at the length sought, so the least over any range of the scan is found in a stack of that many
   entries. Only leftmost S neighbours, and the last L and first S suffix of a word, are compared directly, up to the cap.

Neighbours with a common prefix of ``length`` words are the repeated windows.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages
from .common import materialize, scratch_root

#: Words of a shard aimed at, and tuples a queue holds in memory before it spills. Shards of any size are sorted alike.
SHARD_WORDS, MEMORY_TUPLES = 2_000_000, 200_000


class Spill:
    """Nameless files of int64 rows: they vanish with the process, however it ends."""

    def __init__(self, folder: str | None):
        self.folder = folder

    def file(self):
        return tempfile.TemporaryFile(dir=self.folder)

    def rows(self, file, width: int, at: int, count: int) -> np.ndarray:
        return np.frombuffer(os.pread(file.fileno(), count * width * 8, at * width * 8), np.int64).reshape(-1, width)


class DiskQueue:
    """Priority queue of int tuples of one width, smallest first."""

    BLOCK = 4096

    def __init__(self, spill: Spill, width: int, memory: int):
        self.spill, self.width, self.memory = spill, width, memory
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []  # (next tuple, run) of every run that isn't used up
        self.runs: list[Iterator[tuple]] = []

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.memory:
            self._spill()

    def _spill(self) -> None:
        file = self.spill.file()
        file.write(np.array(sorted(self.heap), np.int64).tobytes())
        file.flush()
        run = self._read(file, len(self.heap))
        self.heap = []
        self.runs.append(run)
        heapq.heappush(self.heads, (next(run), len(self.runs) - 1))

    def _read(self, file, count: int) -> Iterator[tuple]:
        for at in range(0, count, self.BLOCK):
            yield from map(tuple, self.spill.rows(file, self.width, at, min(self.BLOCK, count - at)).tolist())
        file.close()

    def take(self, most: int | None) -> tuple | None:
        """Remove and return the smallest tuple if its first value is at most ``most``; None stands for no bound."""
        heap = self.heap
        if self.heads and (not heap or self.heads[0][0] < heap[0]):
            item, run = self.heads[0]
            if most is not None and item[0] > most:
                return None
            following = next(self.runs[run], None)
            if following is None:
                heapq.heappop(self.heads)
            else:
                heapq.heapreplace(self.heads, (following, run))
            return item
        if heap and (most is None or heap[0][0] <= most):
            return heapq.heappop(heap)
        return None


class DiskList:
    """Int64 values appended in turn, read forwards or backwards in blocks."""

    BLOCK = 1 << 15

    def __init__(self, spill: Spill):
        self.spill, self.file, self.count, self.tail = spill, spill.file(), 0, array("q")

    def append(self, value: int) -> None:
        self.tail.append(value)
        if len(self.tail) >= self.BLOCK:
            self.flush()

    def flush(self) -> None:
        self.file.write(self.tail.tobytes())
        self.file.flush()
        self.count += len(self.tail)
        self.tail = array("q")

    def __iter__(self) -> Iterator[int]:
        self.flush()
        for at in range(0, self.count, self.BLOCK):
            yield from self.spill.rows(self.file, 1, at, min(self.BLOCK, self.count - at))[:, 0].tolist()

    def __reversed__(self) -> Iterator[int]:
        self.flush()
        for end in range(self.count, 0, -self.BLOCK):
            at = max(0, end - self.BLOCK)
            yield from self.spill.rows(self.file, 1, at, end - at)[::-1, 0].tolist()


def leftmost_s(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(type S by place, places of leftmost S suffixes); the last suffix is the least and of type S.

    A suffix is smaller than the next where the first differing neighbours rise, so the type of a place is that of the
    next place whose word differs from its own.
    """
    n = len(text)
    step = np.sign(np.diff(text)).astype(np.int8)
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(at[::-1])[::-1] if n > 1 else at
    s = np.ones(n, bool)
    s[:-1] = np.append(step, 1)[nearest] > 0
    return s, np.flatnonzero(s[1:] & ~s[:-1]) + 1


def names(text: np.ndarray, is_s: np.ndarray, stars: np.ndarray, spill: Spill, memory: int) -> tuple[np.ndarray, DiskList, bool]:
    """Sort the substrings from every leftmost S place to the next: (name by order of place, places in order, all distinct)."""
    shifted = (text - min(0, int(text.min()))).astype(np.uint64) * np.uint64(2) + is_s.astype(np.uint64)  # types break ties of prefixes
    order = DiskList(spill)
    ends = np.append(stars[1:], len(text) - 1) + 1
    runs: list[Iterator[tuple]] = []

    def stored(rows: list[tuple[bytes, int]]) -> Iterator[tuple[bytes, int]]:
        file, sizes = spill.file(), np.array([len(k) for k, _ in rows], np.int64)
        places = np.array([i for _, i in rows], np.int64)
        file.write(sizes.tobytes() + places.tobytes() + b"".join(k for k, _ in rows))
        file.flush()
        n, at = len(rows), 16 * len(rows)
        for b in range(0, n, 4096):
            size, place = spill.rows(file, 1, b, min(4096, n - b))[:, 0], spill.rows(file, 1, n + b, min(4096, n - b))[:, 0]
            data, x = os.pread(file.fileno(), int(size.sum()), at), 0
            at += len(data)
            for s, p in zip(size.tolist(), place.tolist()):
                yield data[x : x + s], p
                x += s
        file.close()

    for b in range(0, len(stars), memory):
        keys = [(shifted[s:e].astype(">u8").tobytes(), b + i) for i, (s, e) in enumerate(zip(stars[b : b + memory].tolist(), ends[b : b + memory].tolist()))]
        keys.sort()
        runs.append(stored(keys) if len(stars) > memory else iter(keys))
    named = np.empty(len(stars), np.int64)
    name, last = -1, None
    for key, i in heapq.merge(*runs):
        if key != last:
            name, last = name + 1, key
        named[i] = name
        order.append(int(stars[i]))
    return named, order, name + 1 == len(stars)


def common(text: np.ndarray, a: int, b: int, cap: int) -> int:
    """Words that the suffixes at a and b have in common, at most ``cap``."""
    n = min(cap, len(text) - max(a, b))
    differ = np.flatnonzero(text[a : a + n] != text[b : b + n])
    return int(differ[0]) if len(differ) else n


class Scan:
    """Least common prefix over the end of a scan. Values are at most the cap, so few entries are kept."""

    def __init__(self):
        self.at: list[int] = []
        self.low: list[int] = []

    def add(self, t: int, value: int) -> None:
        while self.low and self.low[-1] >= value:
            self.low.pop()
            self.at.pop()
        self.low.append(value)
        self.at.append(t)

    def since(self, t: int) -> int:
        """Least value of the entries behind t."""
        return self.low[bisect_left(self.at, t + 1)]


def induced(text: np.ndarray, is_s: np.ndarray, order: DiskList, spill: Spill, memory: int, cap: int) -> tuple[DiskList, DiskList]:
    """All suffixes in descending order and the common prefix of each with the one before it in that list, at most ``cap``.

    ``order``: the leftmost S suffixes, sorted. A cap of 0 leaves the common prefixes out.
    """
    at, s_type = memoryview(text), memoryview(is_s)  # elements as Python ints
    left, left_lcp = DiskList(spill), DiskList(spill)
    queue, scan, last_from, t = DiskQueue(spill, 4, memory), Scan(), {}, 0
    add, since, push, take = scan.add, scan.since, queue.push, queue.take
    stars = iter(order)
    star, before, lcp = next(stars, None), None, 0
    while True:
        word = at[star] if star is not None else None
        item = take(word)  # of one word, L suffixes come before S suffixes
        if item is not None:
            _, _, p, lcp = item
            left.append(p)
            if cap:
                left_lcp.append(lcp)
        elif star is None:
            break
        else:
            p = star
            if cap:
                lcp = common(text, before, p, cap) if before is not None and at[before] == word else 0
            star = next(stars, None)
        before = p
        if cap:
            add(t, lcp)
        if p and not s_type[p - 1]:
            w, up = at[p - 1], 0
            if cap:
                known = last_from.get(w)
                up = 0 if known is None else min(cap, 1 + since(known))
                last_from[w] = t
            push((w, t, p - 1, up))
        t += 1
    out, out_lcp = DiskList(spill), DiskList(spill)
    queue, scan, last_from, t = DiskQueue(spill, 4, memory), Scan(), {}, 0
    add, since, push, take = scan.add, scan.since, queue.push, queue.take
    # descending: words are negated in the queue; the common prefix of an L suffix is with the next L suffix below it
    lefts, prefixes = reversed(left), reversed(left_lcp)
    l_place, l_lcp = next(lefts, None), next(prefixes, 0)
    n = len(text)
    push((-at[n - 1], -1, n - 1, 0))
    before, carried, before_l, lcp = None, 0, False, 0
    while True:
        word = at[l_place] if l_place is not None else None
        item = take(-word if word is not None else None)
        if item is not None:
            _, _, p, lcp = item
            before_l = False
        elif l_place is None:
            break
        else:
            p = l_place
            if cap:
                if before is None or at[before] != word:
                    lcp = 0
                else:
                    lcp = carried if before_l else common(text, before, p, cap)
                carried = l_lcp
            l_place, l_lcp, before_l = next(lefts, None), next(prefixes, 0), True
        out.append(p)
        before = p
        if cap:
            out_lcp.append(lcp)
            add(t, lcp)
        if p and s_type[p - 1]:
            w, up = at[p - 1], 0
            if cap:
                known = last_from.get(w)
                up = 0 if known is None else min(cap, 1 + since(known))
                last_from[w] = t
            push((-w, t, p - 1, up))
        t += 1
    return out, out_lcp


def suffix_array(text: np.ndarray, cap: int, folder: str | None = None, memory: int = MEMORY_TUPLES) -> tuple[DiskList, DiskList]:
    """Suffixes of ``text`` in descending order with common prefixes of neighbours, capped. The last word must be the
    least and occur once."""
    spill = Spill(folder)
    is_s, stars = leftmost_s(text)
    if not len(stars):
        stars = np.array([len(text) - 1])
    named, order, distinct = names(text, is_s, stars, spill, memory)
    if not distinct:
        below, _ = suffix_array(named, 0, folder, memory)
        order = DiskList(spill)
        for i in reversed(below):
            order.append(int(stars[i]))
    return induced(text, is_s, order, spill, memory, cap)


def repeated_windows(parts: list[np.ndarray], length: int, folder: str | None = None, memory: int = MEMORY_TUPLES) -> list[np.ndarray]:
    """By part: the sorted starts of windows of ``length`` words that occur at two places of the parts."""
    ends = np.cumsum([len(p) + 1 for p in parts])
    spill = Spill(folder)
    file = spill.file()
    for i, p in enumerate(parts):
        np.append(p.astype(np.int64), -(i + 1)).tofile(file)  # separators differ, and the last one is the least
    file.flush()
    text = np.memmap(file, np.int64, "r", shape=(int(ends[-1]),)) if parts else np.empty(0, np.int64)
    hit = [[] for _ in parts]
    if not parts:
        return []
    places, prefixes = suffix_array(text, length, folder, memory)
    before = None
    block = 1 << 16
    place, prefix = iter(places), iter(prefixes)
    while chunk := list(islice(place, block)):
        p, near = np.array(chunk), np.array(list(islice(prefix, block))) >= length
        both = np.unique(np.concatenate([p[near], np.append(before if before is not None else -1, p[:-1])[near]])) if near.any() else p[:0]
        before = p[-1]
        owner = np.searchsorted(ends, both, side="right")
        for i in np.unique(owner).tolist():
            hit[i].append(both[owner == i] - (ends[i - 1] if i else 0))
    return [np.unique(np.concatenate(h)) if h else np.empty(0, np.int64) for h in hit]


def spill_folder(spark) -> str | None:
    """The shared folder where it is a mounted one. Elsewhere None: tasks then use the spill folders that Spark gives them."""
    at = urlparse(scratch_root(spark))
    return at.path if at.scheme in ("", "file") else None


def confirm(distinct: DataFrame, length: int, shards: int, memory: int) -> DataFrame:
    """(c, ranges): windows of contents of one place that occur at two places, by the suffix array of each shard."""
    shared = spill_folder(distinct.sparkSession)
    schema = pa.schema([("c", pa.int64()), ("ranges", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])

    def sort_shard(table: pa.Table) -> pa.Table:
        folder = shared
        if folder is None:
            folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
        elif not os.path.isdir(folder):
            os.makedirs(folder, exist_ok=True)
        c, once = np.unique(table.column("c").to_numpy(), return_index=True)  # copies of a row give a content twice
        table = table.take(pa.array(once))
        words = [np.frombuffer(w.as_buffer(), np.uint32) for chunk in table.column("words").chunks for w in chunk]
        ids, ranges = [], []
        for i, (many, skip, starts) in enumerate(zip(table.column("many").to_pylist(), table.column("skip").to_pylist(), repeated_windows(words, length, folder, memory))):
            if len(starts) and not many:  # of a content at several places all windows repeat anyway
                ids.append(int(c[i]))
                ranges.append(passages.as_ranges(starts, skip))
        return pa.Table.from_pydict({"c": ids, "ranges": ranges}, schema=schema)

    sharded = distinct.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int"))
    return sharded.groupBy("shard").applyInArrow(sort_shard, "c long, ranges array<struct<a:int,b:int>>")


def repeated_spans(docs: DataFrame, length: int = passages.LENGTH, gram: int = passages.GRAM, shard_words: int = SHARD_WORDS, memory: int = MEMORY_TUPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, n_words): every maximal run of words covered by windows of ``length`` words that occur at two
    places of the corpus, in one document or in several; all occurrences are listed, the first too.

    Words are separated by ASCII white space and compared by 32-bit hashes. Texts that are null, empty or shorter than
    ``length`` words have no span. Rows equal in every column are one document; rows that share an id but differ are two,
    and both report under that id. A null id is reported as null. Texts of any length are searched whole. An empty table gives no spans. Other columns take no
    part.
    """
    if not 1 <= gram <= length:
        raise ValueError("a gram must be of 1 to `length` words")
    places = passages.recurring(docs, text_col, length, gram)
    distinct = materialize(passages.segments(docs, places, text_col, length), "suffix-segments")
    total = distinct.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(1, -(-total // (4 * shard_words)))
    windows = passages.located(places, materialize(confirm(distinct, length, shards, memory), "suffix-ranges"))
    return passages.spans(docs, windows, length, id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = passages.spans_sql(passages.LENGTH)
