"""The field policy of the five memory types on small blocks with nulls."""

from tesserae.operators import graph, projection
from tesserae.operators.projection import SCHEMAS, edge_table, pairs, project, weighted_postings


def blocks(spark, kind, *rows):
    return spark.createDataFrame([tuple(r.get(f.name) for f in SCHEMAS[kind].fields) for r in rows], SCHEMAS[kind])


def test_semantic(spark):
    full = dict(block_id="s1", kind="formula", label="Fourier Series", statement="sum of waves", subject="maths", aliases=["FS", "series"], evidence=["c1"], relations=[("part_of", "s2"), ("uses", "s2"), ("part_of", None)])
    p = project(blocks(spark, "semantic", full, dict(block_id="s2")), "semantic")
    a, b = p.orderBy("block_id").collect()
    assert [(f.weight, f.text) for f in a.fields] == [(3.0, "Fourier Series"), (1.0, "sum of waves"), (0.5, "formula"), (2.0, "FS"), (2.0, "series"), (1.5, "maths")]
    assert a.embed_text == "[maths] Fourier Series. sum of waves (aka: FS, series)"
    assert {(x.key, x.value) for x in a.identities} == {("label", "fourier series"), ("alias", "fs"), ("alias", "series")}
    assert b.fields == [] and b.edges == [] and [(x.key, x.value) for x in b.facets] == [("has_evidence", "no")]
    e = {(r.src, r.dst): (r.kind, r.predicate) for r in edge_table(p).collect()}
    assert e == {("s1", "c1"): ("evidence", None), ("s1", "s2"): ("relation", "uses")}
    tf = {r.term: r.tf for r in weighted_postings(p).collect()}
    assert tf["t:series"] == 5000 and tf["x:waves"] == 1000


def test_episodic_procedural_provenance_canonical(spark):
    ep = project(blocks(spark, "episodic", dict(block_id="e1", summary="met", occurred_at="2024-05-01T10:00:00Z", outcome="done", tags=["x", None], participants=["ana"])), "episodic").first()
    assert ep.embed_text == "2024-05-01 -- met done" and ("tag", "x") in [(f.key, f.value) for f in ep.facets]
    pr = project(blocks(spark, "procedural", dict(block_id="p1", label="Bake", goal="bread", steps=[("mix", None, ["stir"], ["s1"]), ("heat", "dough", None, None)])), "procedural").first()
    assert pr.embed_text == "Bake. bread 1 mix 2 heat" and [(x.target, x.kind, x.weight) for x in pr.edges] == [("s1", "uses", 0.9)]
    v = project(blocks(spark, "provenance", dict(block_id="r1", record_type="supersession", blocks=["b1"], at="2024", origin=" FILE:x ", supersedes=["b0"])), "provenance")
    assert {(x.key, x.value) for x in v.first().identities} == {("record_subject", "b1"), ("origin", "file:x")} and v.first().fields == []
    c = project(blocks(spark, "canonical", dict(block_id="c1", blob="sha256:1", media_type="text/plain", size=42)), "canonical")
    assert {(r.key, r.value) for r in pairs(c, "keys").collect()} == {("media_type", "text/plain"), ("size", "00000000000000000042")}
    everything = v.unionByName(c)
    assert graph.degrees(edge_table(everything)).first().edges == 1
    assert project(c.select("block_id"), "other").first().facets == []


def test_related_and_cache(spark):
    sha = "sha256:" + "a" * 64
    records = spark.createDataFrame([(1, '{"x": {"y": "%s"}}' % sha), (2, "{}"), (3, None)], "id int, record string")
    assert [r.id for r in projection.related(records, sha).collect()] == [1]
    cache = spark.createDataFrame([("a",), ("b",)], "key string")
    wanted = spark.createDataFrame([("b",), ("c",), ("c",)], "key string")
    assert [r.key for r in projection.uncached(wanted, cache).collect()] == ["c"] and [r.key for r in projection.vacuumed(cache, wanted).collect()] == ["b"]
