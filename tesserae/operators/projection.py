"""What every index reads of a block: weighted text fields, the text to embed, facets, ordered keys, identities and edges.

One projection for each of the five memory types, all with one schema, so modules are a union and each index is one
``explode`` away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import folded

_S, _A = T.StringType(), T.ArrayType(T.StringType())


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SCHEMAS = {
    "canonical": _struct(block_id=_S, blob=_S, media_type=_S, size=T.LongType(), view=_S, view_text=_S),
    "semantic": _struct(block_id=_S, kind=_S, label=_S, statement=_S, subject=_S, aliases=_A, evidence=_A, relations=T.ArrayType(_struct(predicate=_S, target=_S))),
    "episodic": _struct(block_id=_S, summary=_S, occurred_at=_S, ended_at=_S, context=_S, outcome=_S, participants=_A, tags=_A, evidence=_A),
    "procedural": _struct(block_id=_S, label=_S, goal=_S, subject=_S, steps=T.ArrayType(_struct(action=_S, condition=_S, alternatives=_A, uses=_A)), preconditions=_A, success_criteria=_A, evidence=_A),
    "provenance": _struct(block_id=_S, record_type=_S, blocks=_A, at=_S, origin=_S, derived_from=_A, supersedes=_A),
}
FIELD, PAIR, EDGE = "struct<weight:double,text:string>", "struct<key:string,value:string>", "struct<target:string,kind:string,predicate:string,weight:double>"


def _list(items: list[Column], kind: str) -> Column:
    """Flat array of arrays and of single structs, those with a null second field left out."""
    empty = F.array().cast(f"array<{kind}>")
    return F.flatten(F.array(*[F.coalesce(x.cast(f"array<{kind}>"), empty) for x in items])) if items else empty


def _field(weight: float, text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.array(F.struct(F.lit(weight).alias("weight"), text.alias("text"))))


def _fields(weight: float, texts: Column) -> Column:
    return F.transform(F.filter(texts, lambda t: F.coalesce(t, F.lit("")) != ""), lambda t: F.struct(F.lit(weight).alias("weight"), t.alias("text")))


def _pair(key: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.array(F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))))


def _pairs(key: str, values: Column) -> Column:
    return F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.struct(F.lit(key).alias("key"), v.alias("value")))


def _edges(kind: str, targets: Column, weight: float = 1.0) -> Column:
    return F.transform(F.filter(targets, lambda t: t.isNotNull()), lambda t: F.struct(t.alias("target"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("predicate"), F.lit(weight).alias("weight")))


def _has(values: Column) -> Column:
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, "yes").otherwise("no")


def _joined(separator: str, *texts: Column) -> Column:
    return F.concat_ws(separator, *[F.when(t != "", t) for t in texts])


def _flat(steps: Column, name: str) -> Column:
    empty = F.array().cast("array<string>")
    return F.flatten(F.transform(steps, lambda s: F.coalesce(s[name], empty)))


def _policy(kind: str) -> dict[str, Column | list]:
    c = F.col
    if kind == "canonical":
        return dict(
            fields=[_field(0.5, c("media_type")), _field(1.0, c("view_text"))], embed=c("view_text"),
            facets=[_pair("memory_type", F.lit(kind)), _pair("media_type", c("media_type")), _pair("has_normalized_view", F.when(c("view").isNotNull(), "yes").otherwise("no"))],
            keys=[_pair("media_type", c("media_type")), _pair("size", F.lpad(c("size").cast("string"), 20, "0"))], identities=[_pair("blob", c("blob")), _pair("normalized_view", c("view"))], edges=[],
        )
    if kind == "semantic":
        relations = F.transform(F.filter("relations", lambda r: r["target"].isNotNull()), lambda r: F.struct(r["target"].alias("target"), F.lit("relation").alias("kind"), r["predicate"].alias("predicate"), F.lit(1.0).alias("weight")))
        aliases = F.array_join("aliases", ", ")
        embed = F.concat(F.when(c("subject").isNotNull(), F.concat(F.lit("["), c("subject"), F.lit("] "))).otherwise(""), _joined(". ", c("label"), c("statement")), F.when(aliases != "", F.concat(F.lit(" (aka: "), aliases, F.lit(")"))).otherwise(""))
        return dict(
            fields=[_field(3.0, c("label")), _field(1.0, c("statement")), _field(0.5, c("kind")), _fields(2.0, c("aliases")), _field(1.5, c("subject"))], embed=embed,
            facets=[_pair("semantic_kind", c("kind")), _pair("has_evidence", _has(c("evidence"))), _pair("subject", c("subject")), _pairs("predicate", F.array_distinct(F.transform("relations", lambda r: r["predicate"])))],
            keys=[_pair("label", c("label")), _pair("subject", c("subject"))], identities=[_pair("label", folded(c("label"))), _pairs("alias", F.transform("aliases", folded))], edges=[_edges("evidence", c("evidence")), relations],
        )
    if kind == "episodic":
        return dict(
            fields=[_field(3.0, c("summary")), _field(1.5, c("outcome")), _field(1.0, c("context")), _fields(1.5, c("tags")), _fields(1.0, c("participants"))],
            embed=F.concat_ws(" -- ", F.left("occurred_at", F.lit(10)), _joined(" ", c("summary"), c("context"), c("outcome"))),
            facets=[_pair("has_evidence", _has(c("evidence"))), _pairs("tag", c("tags")), _pairs("participant", c("participants"))],
            keys=[_pair("occurred_at", c("occurred_at")), _pair("ended_at", c("ended_at"))], identities=[], edges=[_edges("evidence", c("evidence"))],
        )
    if kind == "procedural":
        steps = c("steps")
        actions = F.transform(steps, lambda s: s["action"])
        numbered = F.array_join(F.transform(actions, lambda a, i: F.concat((i + 1).cast("string"), F.lit(" "), a)), " ")
        return dict(
            fields=[_field(3.0, c("label")), _field(2.5, c("goal")), _fields(1.0, actions), _fields(0.7, F.transform(steps, lambda s: s["condition"])), _fields(0.5, _flat(steps, "alternatives")), _fields(0.7, c("preconditions")), _fields(0.7, c("success_criteria")), _field(1.5, c("subject"))],
            embed=_joined(" ", _joined(". ", c("label"), c("goal")), numbered), facets=[_pair("has_evidence", _has(c("evidence"))), _pair("subject", c("subject"))],
            keys=[_pair("label", c("label")), _pair("subject", c("subject"))], identities=[_pair("label", folded(c("label")))], edges=[_edges("evidence", c("evidence")), _edges("uses", _flat(steps, "uses"), 0.9)],
        )
    return dict(
        fields=[], embed=F.lit(None).cast("string"), facets=[_pair("record_type", c("record_type"))], keys=[_pair("recorded_at", c("at"))],
        identities=[_pairs("record_subject", c("blocks")), _pair("origin", folded(c("origin")))], edges=[_edges("derived_from", c("derived_from")), _edges("supersedes", c("supersedes"))],
    )


def project(blocks: DataFrame, memory_type: str, *kept: str) -> DataFrame:
    """(block_id, memory_type, fields, embed_text, facets, keys, identities, edges) of the blocks of one memory type; an
    unknown type keeps its id alone. Columns named in ``kept`` stay."""
    p = _policy(memory_type) if memory_type in SCHEMAS else dict(fields=[], embed=F.lit(None).cast("string"), facets=[], keys=[], identities=[], edges=[])
    return blocks.select(
        "block_id", F.lit(memory_type).alias("memory_type"), _list(p["fields"], FIELD).alias("fields"), p["embed"].alias("embed_text"), _list(p["facets"], PAIR).alias("facets"),
        _list(p["keys"], PAIR).alias("keys"), _list(p["identities"], PAIR).alias("identities"), _list(p["edges"], EDGE).alias("edges"), *kept,
    )


def pairs(projected: DataFrame, what: str) -> DataFrame:
    """The facets, keys or identities index: (memory_type, block_id, key, value)."""
    return projected.select("memory_type", "block_id", F.explode(what).alias("p")).select("memory_type", "block_id", "p.key", "p.value")


def edge_table(projected: DataFrame) -> DataFrame:
    """The graph index: (src, dst, kind, predicate, weight), one edge for each pair of ends, the later one, weights in
    thousandths."""
    rows = projected.select(F.col("block_id").alias("src"), F.posexplode("edges").alias("at", "e"))
    last = F.max(F.struct("at", "e.kind", "e.predicate", "e.weight")).alias("m")
    return rows.groupBy("src", F.col("e.target").alias("dst")).agg(last).select("src", "dst", "m.kind", "m.predicate", F.round("m.weight", 3).alias("weight"))


def weighted_postings(projected: DataFrame) -> DataFrame:
    """The lexical index: (term, block_id, tf) with tf in thousandths of the field weights, stems and raw tokens apart."""
    from ..functions.text import tokens

    words = projected.select("block_id", F.explode("fields").alias("f")).select("block_id", F.col("f.weight").alias("weight"), F.explode(tokens(F.col("f.text"))).alias("t"))
    both = words.select("block_id", "weight", F.explode(F.array(F.concat(F.lit("t:"), "t"), F.concat(F.lit("x:"), "t"))).alias("term"))
    return both.groupBy("term", "block_id").agg(F.sum(F.round(F.col("weight") * 1000).cast("long")).alias("tf"))


def related(records: DataFrame, block_id: str, json_col: str = "record") -> DataFrame:
    """Provenance records that mention a block anywhere."""
    return records.where(F.array_contains(F.regexp_extract_all(F.col(json_col), F.lit("sha256:[0-9a-f]{64}"), F.lit(0)), block_id))


def uncached(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """The texts whose vectors the cache lacks, once each, by cache key."""
    return wanted.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def vacuumed(cache: DataFrame, keep: DataFrame) -> DataFrame:
    return cache.join(keep.select("key").distinct(), "key", "left_semi")
