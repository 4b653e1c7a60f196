"""The corpus pipeline: quality filter, exact dedup, near-duplicate dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. ``run`` writes every stage's result
to the shared folder as Parquet and reads it back as the next one's input. SQL can't express the classifier, so
ORACLE_SQL is None; tests hold every stage on its own input against a computation by plain loops.

All stages but the last return the columns of their input, extra ones of any name too. Null ids come last where a smallest
id decides; rows that share an id are told apart by all their columns, and of rows equal in every column exact_dedup keeps
one. A null text is judged as an empty one, is a copy of nothing and near nothing, has no tokens, and goes where its cell
of the mixture has none. Texts are read whole, however long. A table without rows gives one without rows in every stage;
without usable labels quality keeps all rows. Only quality reads a second table, ``labels``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm.common import materialize
from tesserae.llm.exact_dedup import exact_dedup
from tesserae.llm.mixing import mix
from tesserae.llm.near_dup import near_dedup
from tesserae.llm.packing import pack
from tesserae.llm.quality import quality_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
