"""What outlives a session beside the indices: statistics as fragments, vectors that travel, and the cache of embeddings."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.planner import Statistics
from .indices import IndexSet, _fs
from .projection import uncached, vacuumed

SCHEMA_VERSION = 1
TAG = ("model", "dims", "space")


class Mismatch(ValueError):
    """Vectors of another model than the one asked for."""


def merged(*fragments: dict) -> dict:
    """Fragments by index as one: later ones win, and what a fragment says of the whole module (under ``module``) wins over all."""
    out: dict = {}
    for f in fragments:
        out |= {k: v for k, v in f.items() if k != "module"}
    for f in fragments:
        out |= f.get("module", {})
    return out


def save_statistics(spark: SparkSession, folder: str, stats: dict[str, Statistics], root: str, fingerprint: str) -> None:
    """One JSON line for each module, keys sorted."""
    rows = [(m, json.dumps({"version": SCHEMA_VERSION, "root": root, "fingerprint": fingerprint, "figures": asdict(s)}, sort_keys=True)) for m, s in sorted(stats.items())]
    spark.createDataFrame(rows, "memory_type string, value string").coalesce(1).write.mode("overwrite").partitionBy("memory_type").text(folder)


def load_statistics(spark: SparkSession, folder: str, module: str) -> dict | None:
    """What was saved of a module; None if there is nothing that can be read."""
    target, fs = _fs(spark, f"{folder}/memory_type={module}")
    if not fs.exists(target):
        return None
    try:
        held = json.loads(spark.read.text(f"{folder}/memory_type={module}").first()[0])
        figures = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in held["figures"].items()}
        return held | {"figures": Statistics(**figures)}
    except (ValueError, KeyError, TypeError):
        return None


def freshness(held: dict | None, root: str, fingerprint: str) -> str:
    """fresh, stale or absent. The root alone isn't enough: a redaction changes what can be read, not what is a member."""
    if held is None:
        return "absent"
    return "fresh" if (held["version"], held["root"], held["fingerprint"]) == (SCHEMA_VERSION, root, fingerprint) else "stale"


def dump_vectors(ix: IndexSet, path: str, tag: dict) -> None:
    """The vectors with the tag of their model; an empty index is refused."""
    rows = ix["vectors"]
    if rows.isEmpty():
        raise ValueError("there are no vectors to dump")
    rows.withColumn("tag", F.lit(json.dumps({k: tag[k] for k in TAG}, sort_keys=True))).write.parquet(path)


def load_vectors(spark: SparkSession, path: str, tag: dict) -> DataFrame:
    """Dumped vectors of the same model; another one is refused by the name of what differs."""
    rows = spark.read.parquet(path)
    held = json.loads(rows.select("tag").first()[0])
    if other := [k for k in TAG if held.get(k) != tag[k]]:
        raise Mismatch(f"vectors differ in {', '.join(other)}")
    return rows.drop("tag")


class EmbeddingCache:
    """Vectors by cache key (``scoring.cache_key``) as appended Parquet files; a vacuum writes a new set and names it last."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _name(self) -> str:
        target, fs = _fs(self.spark, f"{self.folder}/current")
        return self.spark.read.text(f"{self.folder}/current").first()[0] if fs.exists(target) else "first"

    def rows(self) -> DataFrame:
        """(key, v), one row for each key."""
        path = f"{self.folder}/{self._name()}"
        target, fs = _fs(self.spark, path)
        if not fs.exists(target):
            return self.spark.createDataFrame([], "key string, v array<double>")
        return self.spark.read.schema("key string, v array<double>").parquet(path).dropDuplicates(["key"])

    def put(self, vectors: DataFrame) -> None:
        vectors.select("key", F.col("v").cast("array<double>").alias("v")).write.mode("append").parquet(f"{self.folder}/{self._name()}")

    def embed(self, wanted: DataFrame, make) -> DataFrame:
        """(key, v) of ``wanted`` (key, text): held ones are read, ``make`` (a Column function of the text) does the rest, once."""
        fresh = uncached(wanted, self.rows()).select("key", make(F.col("text")).alias("v"))
        self.put(fresh)
        return wanted.select("key").join(self.rows(), "key")

    def vacuum(self, keep: DataFrame) -> None:
        name = uuid.uuid4().hex
        vacuumed(self.rows(), keep).write.parquet(f"{self.folder}/{name}")
        self.spark.createDataFrame([(name,)], "s string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/current")
