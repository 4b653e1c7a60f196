"""The six indices as stored tables, built once from projected blocks and read by every search.

Tables are Parquet under one folder, partitioned by ``memory_type``: ``postings`` (one row for a term and some
blocks that hold it, for both spaces, as stems are the tokens themselves; every file sorted by term, so a query reads the pages of
its terms), ``terms``, ``facets``, ``keys``, ``identities``, ``edges``, ``vectors``, ``blocks`` and ``meta``. A build
writes a new folder and names it in ``current`` last, so a reader sees the old set or the new one, never a part.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring
from ..functions.text import TOKENS, VALUES, analyse, chunks, encoded, lengths
from ..plans.planner import Statistics
from . import graph, projection, vector
from .scratch import saved

MODEL = "hashing/256"
TABLES = ("postings", "terms", "facets", "keys", "identities", "edges", "vectors", "blocks", "meta")
KIND_OF = {"identities": "hash_map", "facets": "bitmap", "keys": "btree", "postings": "inverted", "vectors": "vector", "edges": "graph"}


#: Files over which the postings of one term may be spread, so that a frequent one is no task of its own.
SPREAD = 8


def _inverted(b: pa.RecordBatch, words: list[str], spans: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    """Postings of some rows of a batch. ``spans``: of each field the row, its first place, its number of words and its weight."""
    row, place, n, weight = np.array(spans, np.int64).T
    owner, at = np.repeat(row, n), np.arange(len(words)) + np.repeat(place - (np.cumsum(n) - n), n)
    distinct, code = encoded(words)
    key = code.astype(np.int64) * (int(row[-1]) + 1) + owner
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.diff(key[order], prepend=-1))  # of each posting
    rows, term, size = owner[order][first], code[order][first], np.bincount(owner)
    start = np.flatnonzero(np.diff(term, prepend=-1))  # of each term
    lead = np.zeros(len(first), bool)
    lead[np.unique(rows, return_index=True)[1]] = True
    columns = [
        b.column("block_id").take(pa.array(rows)), pa.array(np.add.reduceat(np.repeat(weight, n)[order], first)), pa.array(size[rows].astype(np.int32)),
        pa.ListArray.from_arrays(pa.array(np.append(first, len(words)).astype(np.int32)), pa.array(at[order].astype(np.int32))),
    ]
    held = pa.ListArray.from_arrays(pa.array(np.append(start, len(first)).astype(np.int32)), pa.StructArray.from_arrays(columns, names=["block_id", "tf", "length", "places"]))
    total = lambda x: pa.array(np.add.reduceat(x.astype(np.int64), start))
    return pa.RecordBatch.from_arrays([distinct.take(pa.array(term[start])), held, total(np.diff(np.append(first, len(words)))), total(lead), total(lead * size[rows])], names=["term", "held", "occurrences", "documents", "length"])


def _postings(parts):
    """Of some blocks the terms, each with the blocks that hold it: weights in thousandths, lengths, and the places of the tokens; a
    field begins one place further, so no phrase reaches over its end. ``documents`` and ``length`` count every block with a token at
    one of its terms alone. A worker holds the batch and the words of few blocks."""
    for b in parts:
        counts, flat = lengths(b.column("fields")), b.column("fields").flatten()
        weights = np.rint(flat.field("weight").to_numpy(zero_copy_only=False) * 1000).astype(np.int64)
        words, spans, row, place = [], [], -1, 0
        for i, owner in enumerate(np.repeat(np.arange(len(counts)), counts).tolist()):
            if i % VALUES == 0:
                texts = flat.field("text").slice(i, VALUES).to_pylist()
            if owner != row:
                if len(words) >= TOKENS:
                    yield _inverted(b, words, spans)
                    words, spans = [], []
                row, place = owner, 0
            found = analyse(texts[i % VALUES] or "")
            spans.append((row, place, len(found), weights[i]))
            words += found
            place += len(found) + 1
        if words:
            yield _inverted(b, words, spans)


def _spaces(places: Column | None = None) -> Column:
    """A term as it stands in both spaces: stems (t:), and raw tokens (x:), which alone have places."""
    one = lambda p, x: F.struct(F.concat(F.lit(p), F.col("term")).alias("term"), x.alias("places"))
    none = F.lit(None).cast("array<int>")
    return F.explode(F.array(one("t:", none), one("x:", none if places is None else places)))


def _both(postings: DataFrame) -> DataFrame:
    rows = postings.select("memory_type", "term", F.explode("held").alias("h")).select("memory_type", "h.block_id", "h.tf", "h.length", _spaces(F.col("h.places")).alias("s"))
    return rows.select("memory_type", "s.term", "block_id", "tf", "s.places", "length")


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - F.lit(by))


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class IndexSet:
    """A stored set of indices. ``build`` makes one, ``open`` reads one, an unreadable one is empty."""

    def __init__(self, spark: SparkSession, folder: str, name: str | None):
        self.spark, self.folder, self.name = spark, folder, name
        self._statistics: dict[str, Statistics] | None = None
        self._schemas: dict | None = None  # as stored: a table without rows has no files to tell them

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> IndexSet:
        target, fs = _fs(spark, f"{folder}/current")
        return cls(spark, folder, spark.read.text(f"{folder}/current").first()[0] if fs.exists(target) else None)

    def __getitem__(self, table: str) -> DataFrame:
        return _both(self._read(table)) if table == "postings" else self._read(table)

    def _read(self, table: str) -> DataFrame:
        """A table as it is stored."""
        if self.name is None:
            raise LookupError("no index has been built")
        if self._schemas is None:
            self._schemas = json.loads(self.spark.read.text(f"{self.folder}/{self.name}/schemas").first()[0])
        return self.spark.read.schema(T.StructType.fromJson(self._schemas[table])).parquet(f"{self.folder}/{self.name}/{table}")

    @classmethod
    def build(cls, spark: SparkSession, projected: DataFrame, blocks: DataFrame | None, folder: str, chunked: bool = True) -> IndexSet:
        """Write all tables. ``projected``: rows of ``projection.project``; ``blocks``: (memory_type, block_id, subject, tags,
        occurred_at, evidence, content, digest), of which those without content aren't resolvable and aren't indexed. Where the
        projected rows have these in a column ``stored``, as ``adapt.whole`` gives them, ``blocks`` is None and nothing is joined.

        Where the members and the model are those of the present set, nothing is built."""
        held = cls.open(spark, folder)
        key = ["memory_type", "block_id"]
        stored = projected.select(*key, "stored.*") if blocks is None else blocks
        each = stored.groupBy("memory_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*key, F.isnull("content")).cast("decimal(38,0)")).alias("h")).collect()  # a row for each module
        mark = json.dumps({"n": sum(r.n for r in each), "members": str(sum(int(r.h) for r in each)) if each else None, "model": MODEL, "chunked": chunked})
        if held.name is not None and held["meta"].first()["mark"] == mark:
            return held
        name = uuid.uuid4().hex
        at = f"{folder}/{name}"
        if blocks is not None:  # the texts are joined once
            rows = blocks.select(*key, F.struct(*[c for c in blocks.columns if c not in key]).alias("stored")).join(projected, key, "left")
            projected = saved(rows, "projected")
        live = projected.where(F.col("stored.content").isNotNull())
        schemas = {}
        only = each[0].memory_type if len(each) == 1 and (each[0].memory_type or "").isalnum() else None

        def write(df, table, *sort):
            schemas[table] = T.StructType([f for f in df.schema if f.name != "memory_type"]).add("memory_type", "string").jsonValue()
            if only is None:  # in the order that writing by module asks for, so it isn't sorted again
                (df.sortWithinPartitions("memory_type", *sort) if sort else df).write.partitionBy("memory_type").parquet(f"{at}/{table}")
            else:
                df = df.drop("memory_type")
                (df.sortWithinPartitions(*sort) if sort else df).write.parquet(f"{at}/{table}/memory_type={only}")
            return read(table)

        read = lambda t: spark.read.schema(T.StructType.fromJson(schemas[t])).parquet(f"{at}/{t}")
        kind = dict(live.dtypes)["block_id"]
        found = None
        for m in sorted(r.memory_type for r in each if r.memory_type is not None):
            rows = live.where(F.col("memory_type") == m).select("block_id", "fields").mapInArrow(_postings, f"term string, held array<struct<block_id:{kind},tf:bigint,length:int,places:array<int>>>, occurrences long, documents long, length long").withColumn("memory_type", F.lit(m))
            found = rows if found is None else found.unionByName(rows)
        if found is None:  # no block at all
            found = spark.createDataFrame([], f"term string, held array<struct<block_id:{kind},tf:bigint,length:int,places:array<int>>>, occurrences long, documents long, length long, memory_type string")
        postings = write(found.repartition("term", F.pmod(F.xxhash64(F.col("held")[0]["block_id"]), F.lit(SPREAD))), "postings", "term")
        known = postings.groupBy("memory_type", "term").agg(F.sum(F.size("held")).alias("df"), F.sum("occurrences").alias("n"))
        known = known.select("memory_type", _spaces().alias("s"), "df", "n").select("memory_type", "s.term", "df", F.when(F.startswith("s.term", F.lit("x:")), F.col("n")).otherwise(F.lit(0)).alias("occurrences"))
        write(known, "terms", "term")
        for table, column in (("facets", "facets"), ("keys", "keys"), ("identities", "identities")):
            write(projection.pairs(live, column).repartitionByRange("memory_type", "key", "value"), table, "key", "value")
        edges = live.select("memory_type", F.col("block_id").alias("src"), F.posexplode("edges").alias("at", "e")).select("memory_type", "src", F.col("e.target").alias("dst"), "at", "e.kind", "e.predicate", "e.weight")
        last = edges.groupBy("memory_type", "src", "dst").agg(F.max(F.struct("at", "kind", "predicate", "weight")).alias("m"))
        write(last.select("memory_type", "src", "dst", "m.kind", "m.predicate", F.round("m.weight", 3).alias("weight")).repartitionByRange("memory_type", "src"), "edges", "src")
        texts = live.where(F.col("embed_text").isNotNull()).select(*key, "embed_text")
        if chunked:
            pieces = texts.select(*key, F.explode(chunks("embed_text")).alias("c")).select(*key, F.col("c.position").alias("chunk"), "c.start", "c.end", F.col("c.text").alias("text"))
        else:
            pieces = texts.select(*key, F.lit(0).alias("chunk"), F.lit(0).alias("start"), F.length("embed_text").alias("end"), F.col("embed_text").alias("text"))
        write(vector.with_vectors(pieces, "text", "v"), "vectors")
        haystack = F.lower(F.array_join(F.transform("fields", lambda f: f["text"]), " "))
        write(projected.select(*key, "stored.*", F.when(F.col("stored.content").isNotNull(), haystack).alias("haystack")), "blocks")
        meta = cls._measured(read).withColumn("mark", F.lit(mark)).coalesce(1)
        schemas["meta"] = meta.schema.jsonValue()
        meta.write.parquet(f"{at}/meta")
        spark.createDataFrame([(json.dumps(schemas),)], "s string").coalesce(1).write.text(f"{at}/schemas")
        spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").text(f"{folder}/current")
        return cls(spark, folder, name)

    @staticmethod
    def _measured(read) -> DataFrame:
        """The statistics of every module, from the tables just written."""
        count = F.count(F.lit(1)).alias
        base = read("blocks").groupBy("memory_type").agg(count("blocks"), F.sum(F.col("content").isNotNull().cast("long")).alias("resolvable"))
        postings = read("postings").groupBy("memory_type").agg(F.sum("documents").alias("documents"), F.sum("length").alias("length"), (F.sum(F.size("held")) * 2).alias("postings"))
        parts = [
            postings, read("vectors").groupBy("memory_type").agg(count("vectors")),
            read("edges").groupBy("memory_type").agg(count("edges"), F.countDistinct("src").alias("sources")), read("keys").where("key = 'occurred_at'").groupBy("memory_type").agg(count("timed")),
        ]
        for p in parts:
            base = base.join(p, "memory_type", "left")
        return base

    def statistics(self) -> dict[str, Statistics]:
        """What the planner is told, read once from the stored figures."""
        if self._statistics is None:
            subjects: dict[str, list] = defaultdict(list)
            if self.name is not None:
                top = self["facets"].where("key = 'subject'").groupBy("memory_type", "value").count()
                for r in top.orderBy(F.desc("count"), "value").limit(32 * 5).collect():
                    subjects[r.memory_type].append((r.value, r["count"]))
            rows = self["meta"].collect() if self.name is not None else []
            zero = lambda r, k: int(r[k] or 0)
            self._statistics = {
                r.memory_type: Statistics(zero(r, "blocks"), zero(r, "postings"), zero(r, "vectors"), scoring.DIMS, zero(r, "edges"), zero(r, "edges") / max(1, zero(r, "sources")), subjects=tuple(subjects[r.memory_type][:32]), timed=zero(r, "timed"))
                for r in rows
            }
            self._lengths = {r.memory_type: (zero(r, "documents"), zero(r, "length")) for r in rows}
        return self._statistics

    def capability(self, module: str, table: str, model: str = MODEL, members: DataFrame | None = None) -> str:
        """ready, empty, stale (other members than now) or model_mismatch."""
        if self.name is None or module not in self.statistics() or self[table].where(F.col("memory_type") == module).isEmpty():
            return "empty"
        if table == "vectors" and json.loads(self["meta"].first()["mark"])["model"] != model:
            return "model_mismatch"
        if members is not None:
            held = self["blocks"].where(F.col("memory_type") == module).select("block_id")
            if not (held.exceptAll(members.select("block_id")).isEmpty() and members.select("block_id").exceptAll(held).isEmpty()):
                return "stale"
        return "ready"

    def report(self) -> DataFrame:
        """(index, memory_type, n) of every table."""
        out = None
        for table, kind in KIND_OF.items():
            n = F.sum(F.size("held")) * 2 if table == "postings" else F.count(F.lit(1))
            rows = self._read(table).groupBy("memory_type").agg(n.alias("n")).select(F.lit(kind).alias("index"), "memory_type", "n")
            out = rows if out is None else out.unionByName(rows)
        return out

    def collect(self, dry_run: bool = True) -> list[str]:
        """Sets that are no longer current; deleted unless it is a dry run."""
        target, fs = _fs(self.spark, self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(target)]
        gone = sorted(n for n in names if n not in ("current", self.name))
        for n in [] if dry_run else gone:
            fs.delete(_fs(self.spark, f"{self.folder}/{n}")[0], True)
        return gone

    # searches: (id, score) rows, unordered

    def _of(self, table: str, scope: str) -> DataFrame:
        return self[table].where(F.col("memory_type") == scope)

    def exact(self, scope: str, text: str) -> DataFrame:
        """By id for a digest, else by label or alias, folded."""
        text = text.strip()
        if text.startswith("sha256:"):
            found = self._of("blocks", scope).where((F.col("digest") == text) | (F.col("block_id").cast("string") == text)).select("block_id")
        else:
            found = self._of("identities", scope).where(F.col("key").isin("label", "alias") & (F.col("value") == text.lower())).select("block_id")
        return found.distinct().select(F.col("block_id").alias("id"), F.lit(1.0).alias("score"))

    def term(self, scope: str, terms: list[str], mask: DataFrame | None = None, groups: list[list[str]] | None = None, phrase: list[str] | None = None) -> DataFrame:
        """BM25 over both spaces as a share of what the query could score at most; with ``groups`` only blocks with a term of
        each, with ``phrase`` only those that hold it in one field. Reads the postings of the terms alone."""
        self.statistics()
        documents, total = self._lengths.get(scope, (0, 0))
        wanted = list(dict.fromkeys([*terms, *(phrase or []), *(t for g in groups or [] for t in g)]))
        known = {r.term: r.df for r in self._of("terms", scope).where(F.col("term").isin(wanted)).collect()}  # a row for each term of the query
        idf = {t: float(scoring.idf_of(documents, known[t])) for t in terms if known.get(t)}
        ceiling = sum(x * (scoring.K1 + 1) / (scoring.K1 * (1 - scoring.B) + 1) for x in idf.values())
        rows = self._read("postings").where((F.col("memory_type") == scope) & F.col("term").isin(list(dict.fromkeys(t[2:] for t in wanted))))
        rows = _both(rows).where(F.col("term").isin(wanted))
        rows = rows if mask is None else rows.join(mask.select(F.col("id").alias("block_id")), "block_id", "left_semi")
        weight = F.try_element_at(F.create_map(*[F.lit(x) for kv in idf.items() for x in kv]), F.col("term")) if idf else F.lit(None).cast("double")
        part = F.when(weight.isNotNull(), scoring.bm25(F.col("tf") / F.lit(1000.0), F.col("length"), F.lit(max(total, 1) / max(documents, 1)), weight)).otherwise(0.0)
        per = rows.select("block_id", "term", part.alias("part"), "places").groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("term", "part"))).alias("ps"), F.collect_list(F.when(F.col("places").isNotNull(), F.struct("term", "places"))).alias("at"))
        has = lambda names: F.exists("ps", lambda p: p["term"].isin(names))
        per = per.where(has(terms)) if terms else per
        for g in groups or []:
            per = per.where(has(g))
        if phrase:
            spot = lambda t: F.filter("at", lambda a: a["term"] == t)[0]["places"]
            for t in phrase:
                per = per.where(has([t]))
            starts = spot(phrase[0])
            for i, t in enumerate(phrase[1:], 1):
                starts = F.array_intersect(starts, _moved(spot(t), i))
            per = per.where(F.size(starts) > 0)
        score = F.least(F.lit(1.0), F.aggregate("ps", F.lit(0.0), lambda a, p: a + p["part"]) / F.lit(ceiling or 1.0))
        return per.select(F.col("block_id").alias("id"), score.alias("score"))

    def vectors(self, scope: str, query: list[float], mask: DataFrame | None = None) -> DataFrame:
        """Every masked block by the best of its chunks, exactly."""
        rows = self._of("vectors", scope)
        rows = rows if mask is None else rows.join(mask.select(F.col("id").alias("block_id")), "block_id", "left_semi")
        near = [(i, float(x)) for i, x in enumerate(query) if x]
        dot = F.lit(0.0)
        for i, x in near:  # a hashing query has few buckets
            dot = dot + F.get("v", F.lit(i)) * F.lit(x)
        hits = rows.select(F.col("block_id").alias("block"), dot.alias("score"), "chunk")
        return vector.best_chunk(hits).where("score > 0").select(F.col("block").alias("id"), "score")

    def scan(self, scope: str, terms: list[str]) -> DataFrame:
        """Share of the terms that stand anywhere in the block's text; without terms every block scores 1."""
        rows = self._of("blocks", scope).where(F.col("content").isNotNull())
        if not terms:
            return rows.select(F.col("block_id").alias("id"), F.lit(1.0).alias("score"))
        found = sum((F.coalesce(F.contains("haystack", F.lit(t)), F.lit(False)).cast("int") for t in terms), F.lit(0))
        return rows.select(F.col("block_id").alias("id"), (found / F.lit(float(len(terms)))).alias("score")).where("score > 0")

    def mask(self, scope: str, subject: str | None = None, tags: tuple[str, ...] = (), since: str | None = None, until: str | None = None) -> DataFrame | None:
        """(id) of the blocks that the facets and ordered keys admit; None if nothing was asked of them."""
        out = None

        def both(rows):
            return rows if out is None else out.join(rows, "id", "left_semi")

        for key, value in [*([("subject", subject)] if subject else []), *(("tag", t) for t in tags)]:
            out = both(self._of("facets", scope).where((F.col("key") == key) & (F.col("value") == value)).select(F.col("block_id").alias("id")))
        if since or until:
            rows = self._of("keys", scope).where("key = 'occurred_at'")
            rows = rows if since is None else rows.where(F.col("value") >= since)
            rows = rows if until is None else rows.where(F.col("value") <= until)
            out = both(rows.select(F.col("block_id").alias("id")))
        return out

    def graphs(self) -> list[DataFrame]:
        """The edges of each module that has any: expansions never change graphs."""
        return [self._of("edges", s) for s, x in sorted(self.statistics().items()) if x.edges]

    def expand(self, seeds: DataFrame, depth: int, **options) -> DataFrame:
        """Targets are named as strings; those that no block can be are external and left out."""
        kind = dict(self["blocks"].dtypes)["block_id"]
        graphs = [g.withColumn("src", F.col("src").cast("string")) for g in self.graphs()]
        hits = graph.federated(graphs, seeds.select(F.col("id").cast("string").alias("id")), depth, **options)
        return hits.withColumn("id", F.col("id").try_cast(kind)).where("id is not null")

    def unseen(self, terms: list[str]) -> float:
        """The share of the terms that no module knows; without a vocabulary 0."""
        if not terms or self.name is None or not any(s.postings for s in self.statistics().values()):
            return 0.0
        known = {r.term for r in self["terms"].where(F.col("term").isin(terms)).select("term").distinct().collect()}
        return sum(t not in known for t in terms) / len(terms)

    def predicates(self) -> frozenset[str]:
        if self.name is None:
            return frozenset()
        return frozenset(r.predicate for r in self["edges"].where("predicate is not null").select("predicate").distinct().limit(4096).collect())
