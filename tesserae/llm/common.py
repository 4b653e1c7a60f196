"""Helpers shared by the training-data operators: scratch tables, size-checked broadcasts, word hashing."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only while its measured size stays under this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20

_made: list[tuple[SparkSession, str]] = []
_local_dir: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session (tests) gets a temporary folder of its own; on a cluster that is an error,
    since a folder of one machine cannot be read by the other executors.
    """
    global _local_dir
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="tesserae-")
    return f"file://{_local_dir}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete the scratch table that ``materialize`` returned as ``df``, once nothing reads it any more."""
    _delete(df.sparkSession, df._scratch)
    _made[:] = [x for x in _made if x[1] != df._scratch]


def sweep() -> None:
    """Delete every scratch table made so far. Call it once the results that read them have been written."""
    while _made:
        _delete(*_made.pop())


@atexit.register
def _sweep_at_exit() -> None:
    try:
        sweep()
    except Exception:  # noqa: BLE001  the JVM may be gone already; only the local default folder is left then
        _made.clear()
    if _local_dir is not None:
        import shutil

        shutil.rmtree(_local_dir, ignore_errors=True)


def small_enough(rows: int, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> bool:
    return rows * bytes_per_row <= limit


def maybe_broadcast(df: DataFrame, rows: int, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast where the measured row count allows it; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if small_enough(rows, bytes_per_row, limit) else df


#: Most bytes of a Bloom filter; beyond it rows aren't sieved before the join that decides.
SIEVE_BYTES = 8 << 20


def sieved(df: DataFrame, column: str, keys: DataFrame, n: int) -> DataFrame:
    """``df`` without most rows whose long ``column`` isn't among the ``n`` distinct ``keys`` (one long column, no nulls).

    A Bloom filter of about 12 bits a key is put together on the executors and broadcast, so that wide rows leave before a
    shuffle. It may keep others, so the join that decides still follows; where the filter would be too large, all stay.
    """
    bits = max(1 << 10, 1 << (12 * n - 1).bit_length())
    if bits // 8 > SIEVE_BYTES:
        return df
    places = lambda v: [(mix64(v.view(np.uint64) + np.uint64(i * 0x632BE59BD9B4E019 % 2**64)) & np.uint64(bits - 1)).astype(np.int64) for i in range(4)]

    def build(parts):
        words = np.zeros(bits // 64, np.int64)
        for b in parts:
            for at in places(b.column(0).to_numpy()):
                np.bitwise_or.at(words, at >> 6, np.left_shift(np.int64(1), at & 63))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_pydict({"word": used.astype(np.int32), "bits": words[used]})

    found = keys.mapInArrow(build, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def may(values: pd.Series) -> pd.Series:
        held, ok = shared.value, np.ones(len(values), bool)
        for at in places(values.to_numpy(np.int64)):
            ok &= (held[at >> 6] >> (at & 63)) & 1 == 1
        return pd.Series(ok, index=values.index)

    return df.where(may(q(column)))


def fresh(df_columns: list[str], base: str) -> str:
    """A column name that clashes with none of ``df_columns`` (case-insensitively, as Spark compares them)."""
    taken = {c.lower() for c in df_columns}
    name, n = f"__{base}", 0
    while name.lower() in taken:
        n += 1
        name = f"__{base}_{n}"
    return name


def q(name: str):
    """Column by exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_hash(df: DataFrame):
    """64-bit hash over every column of a row: tells rows apart that share an id. Maps are hashed by their entries."""
    parts = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        parts.append(F.to_json(F.struct(q(field.name).alias("v"))) if kind in ("map", "variant") else q(field.name))
    return F.xxhash64(*parts, *[F.isnull(q(f.name)) for f in df.schema.fields])


def keep_winners(docs: DataFrame, grouped: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows of a group other than its winner.

    ``grouped`` has (id, row, wid, wrow) for each row of a group of two or more: the row's id and row_hash, and those of
    the row that stays. Rows equal in every column share a key; of those that win, one stays. The removal is an anti
    join, broadcast while the keys are few, shuffled beyond that.
    """
    both = materialize(grouped, "groups")
    is_winner = F.col("id").eqNullSafe(F.col("wid")) & (F.col("row") == F.col("wrow"))
    row, rid, rrow = (fresh(docs.columns, x) for x in ("row", "other_id", "other_row"))
    lost = materialize(both.where(~is_winner).select(q("id").alias(rid), q("row").alias(rrow)).distinct(), "lost")
    repeated = both.where(is_winner).groupBy("id", "row").count().where("count > 1")
    repeated = materialize(repeated.select(q("id").alias(rid), q("row").alias(rrow)), "repeated")
    own = [q(c) for c in docs.columns]
    keyed = docs.withColumn(row, row_hash(docs))
    same = q(id_col).eqNullSafe(q(rid)) & (q(row) == q(rrow))
    kept = keyed.join(maybe_broadcast(lost, lost.count(), 64), same, "left_anti")
    if n := repeated.count():
        side = maybe_broadcast(repeated, n, 64)
        first = F.first(F.struct(*own)).alias(rid)  # the rows of a key are equal
        once = kept.join(side, same, "left_semi").groupBy(q(id_col), row).agg(first)
        kept = kept.join(side, same, "left_anti").select(*own).unionByName(once.select(f"`{rid}`.*"))
    return kept.select(*own)


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand. Bounded: emptied once it holds ``limit`` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= self.limit:
            self.clear()
        self[word] = h
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def _power_table(n: int, sign: int) -> np.ndarray:
    """B**0 .. B**(n-1) modulo 2**64, of the base or of its inverse; kept and extended by doubling."""
    table, step = _powers[sign], _BASE if sign > 0 else _INVERSE
    while len(table) < n:
        factor = np.uint64(pow(step, len(table), 1 << 64))
        table = np.concatenate([table, table * factor])
    _powers[sign] = table
    return table[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of ``n`` words: equal windows have equal hashes wherever they stand."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    sums = np.empty(len(words) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(words * _power_table(len(words), 1), out=sums[1:])
    return mix64((sums[n:] - sums[:-n]) * _power_table(count, -1))


def span_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Signed hash of the words of every span [start, end): equal spans have equal hashes wherever they stand."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power_table(len(words), 1), out=sums[1:])
    back = _power_table(len(words) + 1, -1)
    return mix64((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64)).view(np.int64)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every run of ``width`` values, by doubling."""
    if len(values) < width:
        return np.empty(0, values.dtype)
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def batches(rows: Iterator[dict], schema: pa.Schema, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Dicts of equally long lists or arrays, one Arrow batch each, cut to at most ``size`` rows."""
    for columns in rows:
        batch = pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


WORD = re.compile(r"\w+")
