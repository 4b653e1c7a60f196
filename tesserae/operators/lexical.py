"""Lexical index: postings, lengths, frequencies, BM25, phrases, term groups and the exhaustive scan."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import encoded, lengths as sizes_of, query_tokens, runs, tokens


def analysed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens)"""
    return docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("tokens"))


def postings(docs: DataFrame) -> DataFrame:
    """(term, id, tf): counted inside each text, so no text is shuffled for it."""
    return docs.select("id", "tokens").mapInArrow(_counted, f"term string, id {dict(docs.dtypes)['id']}, tf long")


def _counted(parts):
    """The postings of batches of (id, tokens), of some texts at a time."""
    for b in parts:
        sizes = sizes_of(b.column("tokens"))
        for at, n in runs(sizes):
            distinct, place = encoded(b.column("tokens").slice(at, n).flatten())
            key, tf = np.unique(np.repeat(np.arange(n), sizes[at : at + n]) * max(1, len(distinct)) + place, return_counts=True)
            row, term = np.divmod(key, max(1, len(distinct)))
            yield pa.RecordBatch.from_arrays([distinct.take(pa.array(term)), b.column("id").slice(at, n).take(pa.array(row)), pa.array(tf.astype(np.int64))], names=["term", "id", "tf"])


def positions(docs: DataFrame) -> DataFrame:
    """(term, id, pos), for phrases."""
    return docs.select("id", F.posexplode("tokens").alias("pos", "term"))


def lengths(docs: DataFrame) -> DataFrame:
    """(id, length) of the texts that have a token."""
    return docs.select("id", F.size("tokens").alias("length")).where("length > 0")


def document_frequencies(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def frequent_terms(docs: DataFrame, n: int = 100) -> DataFrame:
    return document_frequencies(docs).orderBy(F.desc("df"), "term").limit(n)


def _equal(term: str):
    return lambda t: t == F.lit(term)


def term_scan(docs: DataFrame, query: str, mask: DataFrame | None = None) -> DataFrame:
    """(id, score): BM25 of the query's terms over the masked texts, as a share of what the query could score at most.

    Frequencies and lengths are those of all texts; the mask only bounds what is scored. One pass over the tokens keeps
    the query's terms alone, so nothing but (id, term) counts of matching texts is shuffled.
    """
    terms = query_tokens(query)
    per = docs.select("id", F.size("tokens").alias("length"), *[F.size(F.filter("tokens", _equal(x))).alias(f"tf{i}") for i, x in enumerate(terms)]).where("length > 0")
    totals = per.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    scored = (per if mask is None else per.join(mask.select("id"), "id", "left_semi")).crossJoin(F.broadcast(totals))  # one row
    none, total, most = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for i in range(len(terms)):
        weight = scoring.idf(F.col("n"), F.col(f"df{i}"))
        part = scoring.bm25(F.col(f"tf{i}"), F.col("length"), F.col("average"), weight)
        total, most = total + F.when(F.col(f"tf{i}") > 0, part).otherwise(none), most + scoring.bm25_ceiling(weight)
    hit = F.greatest(*[F.col(f"tf{i}") for i in range(len(terms))], F.lit(0)) > 0
    return scored.where(hit).select("id", F.least(F.lit(1.0), F.when(most > 0, total / most).otherwise(0.0)).alias("score"))


def seq_scan(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): share of the query's terms that stand anywhere in the text; without terms every text scores 1."""
    terms = query_tokens(query)
    if not terms:
        return docs.select(F.col(id_col).alias("id"), F.lit(1.0).alias("score"))
    found = sum((F.contains(F.lower(F.col(text_col)), F.lit(t)).cast("int") for t in terms), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), (found / F.lit(float(len(terms)))).alias("score")).where("score > 0")


def phrase(docs: DataFrame, words: list[str]) -> DataFrame:
    """Ids of the texts with these tokens in a row, matched inside each text: nothing is shuffled."""
    held = F.array_contains("tokens", words[0])
    for w in words[1:]:
        held = held & F.array_contains("tokens", w)
    spaced = F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" "))
    return docs.where(held & F.contains(spaced, F.lit(f" {' '.join(words)} "))).select("id")


def all_groups(docs: DataFrame, groups: list[list[str]]) -> DataFrame:
    """Ids of the texts with a term of every group."""
    have = [F.arrays_overlap("tokens", F.array(*map(F.lit, g))) for g in groups]
    keep = have[0]
    for h in have[1:]:
        keep = keep & h
    return docs.where(keep).select("id")


def out_of_vocabulary(docs: DataFrame, query: str) -> DataFrame:
    """(terms, unseen, ratio) of a query against the vocabulary of the texts; an empty vocabulary gives 0."""
    terms = query_tokens(query)
    seen = docs.select(*[F.max(F.array_contains("tokens", t).cast("int")).alias(f"s{i}") for i, t in enumerate(terms)], F.max(F.size("tokens")).alias("any"))
    unseen = sum((F.lit(1) - F.coalesce(F.col(f"s{i}"), F.lit(0)) for i in range(len(terms))), F.lit(0))
    unseen = F.when(F.coalesce(F.col("any"), F.lit(0)) == 0, F.lit(0)).otherwise(unseen)
    return seen.select(F.lit(len(terms)).alias("terms"), unseen.alias("unseen"), (unseen / F.lit(max(1, len(terms)))).alias("ratio"))
