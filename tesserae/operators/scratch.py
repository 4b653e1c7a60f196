"""Written tables that cut lineage, in the folder that the session names, and the spreading of small inputs over all cores."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Inputs below this are read by fewer tasks than there are cores; they are dealt out anew. Larger ones have splits enough.
SMALL_BYTES = 256 << 20
_own: list[str] = []


def root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where a local session has none, a temporary folder; a cluster must name one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tesserae-engine-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet and read back."""
    path = f"{root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def size_of(spark: SparkSession, path: str) -> int:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def spread(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet table at ``path``; a small one, which may be a single row group, is dealt out over the cores."""
    df = spark.read.parquet(path)
    return df.repartition(spark.sparkContext.defaultParallelism) if size_of(spark, path) < SMALL_BYTES else df
