"""Operators on small fixtures: what SQL over the driver's tables doesn't reach."""

import hashlib
import os

import numpy as np
from pyspark.sql import functions as F

from tesserae.functions import ingest, scoring, text
from tesserae.operators import adapt, fusion, graph, indices, lexical, lifecycle, masks, stats, vector
from tesserae.plans import planner, search
from tesserae.sources import files
from tesserae.streaming import events

STATS = planner.Statistics(blocks=3000, postings=30_000, vectors=1000, edges=500, degree=2.0)


def ids(df, c="id"):
    return sorted(r[c] for r in df.select(c).collect())


def test_tokens_join_underscores_and_drop_short(spark):
    df = spark.createDataFrame([(1, "Función a_n, x Ab 12"), (2, None), (3, "")], "id int, t string")
    got = {r.id: r.k for r in df.select("id", text.tokens(F.col("t")).alias("k")).collect()}
    assert got == {1: ["función", "a_n", "ab", "12"], 2: [], 3: []}
    assert text.query_tokens("the wave of the") == ["wave"] and text.query_tokens("the of") == ["the", "of"]


def test_chunks_cover_and_overlap():
    t = ("word " * 900).strip()
    spans = text.chunk_spans(t)
    assert spans[0][1] == 0 and spans[-1][2] == len(t) and all(b[1] < a[2] for a, b in zip(spans, spans[1:]))
    assert text.chunk_spans("") == [] and text.chunk_spans(None) == []


def test_sections():
    got = ingest.markdown_sections("# A\nbody\n```\n# no\n```\n## Empty\n\n## B\nx")
    assert [(s["heading"], s["first"], s["last"]) for s in got] == [("A", 1, 5), ("B", 8, 9)]


def test_svg_media_and_proposals(spark):
    df = spark.createDataFrame([(1, "<svg><title>T</title><text>a<tspan>b</tspan></text></svg>", "x.SVG"), (2, None, "y")], "id int, s string, p string")
    got = df.select(ingest.svg_text(F.col("s")).alias("s"), ingest.media_type(F.col("p")).alias("m")).collect()
    assert (got[0].s, got[0].m) == ("T\na b\n", "image/svg+xml") and got[1].m == ingest.UNKNOWN
    docs = spark.createDataFrame([(1, "# A\n" + "x" * 5000), (2, "no heading")], "doc_id int, text string")
    p = ingest.proposals(docs).collect()
    assert len(p) == 1 and p[0].confidence == "0.90" and len(p[0].statement) == 4000 and p[0].locator == "lines:1-2"


def test_render_half_even(spark):
    df = spark.createDataFrame([(0.125,), (0.375,), (0.995,), (1.7,), (-1.0,)], "x double")
    assert [r[0] for r in df.select(scoring.render(F.col("x"))).collect()] == ["0.12", "0.38", "1.00", "1.00", "0.00"]


def test_hashing_vectors_agree_with_the_driver(spark):
    docs = spark.createDataFrame([(1, "wave energy wave"), (2, None)], "doc_id int, text string")
    got = {r.bucket: r.value for r in vector.hashed_terms(lexical.analysed(docs)).collect()}
    raw = {}
    for t in "wave energy wave".split():
        h = hashlib.sha256(t.encode()).digest()
        raw[int.from_bytes(h[:4], "big") % 256] = raw.get(int.from_bytes(h[:4], "big") % 256, 0) + (1 if h[4] % 2 else -1)
    norm = sum(x * x for x in raw.values()) ** 0.5
    assert got.keys() == raw.keys() and all(abs(got[b] - x / norm) < 1e-12 for b, x in raw.items())
    assert {i for i, x in enumerate(search.query_vector("wave energy")) if x} == set(raw)


def test_no_mask_is_not_an_empty_mask(spark):
    rows = spark.createDataFrame([(1,), (2,)], "id int")
    assert ids(masks.masked(rows, None)) == [1, 2] and ids(masks.masked(rows, rows.limit(0))) == []


def test_phrase_needs_neighbours(spark):
    docs = lexical.analysed(spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha gamma beta"), (3, None)], "doc_id int, text string"))
    assert ids(lexical.phrase(docs, ["alpha", "beta"])) == [1]


def test_exact_hit_leads_and_ties_go_by_id(spark):
    rows = spark.createDataFrame([(i, 0.5) for i in range(5)], "id int, score double")
    exact = spark.createDataFrame([(4, 1.0)], "id int, score double")
    fused = fusion.fuse([fusion.ranked(rows, "term", 5), fusion.ranked(exact, "exact", 1, exact=True)], {"term": 0.85})
    assert [r.id for r in fusion.top(fused, 5).collect()] == [4, 0, 1, 2, 3]


def test_graph_with_a_cycle_and_federation(spark):
    e = spark.createDataFrame([("a", "b", "k", 1.0), ("b", "a", "k", 1.0), ("b", "c", "k", 0.5), ("a", "b", "j", 0.2)], "src string, dst string, kind string, weight double")
    seeds = spark.createDataFrame([("a",)], "id string")
    got = {r.id: (r.score, r.depth) for r in graph.expand(e, seeds, 3).collect()}
    assert got == {"b": (0.5, 1), "c": (0.125, 2)}
    parts = [e.where("dst = 'b'"), e.where("dst = 'c'")]
    assert ids(graph.federated(parts, seeds, 2)) == ["b"]
    assert ids(graph.closure(e, spark.createDataFrame([("c",)], "id string"))) == ["a", "b", "c"]


def test_histogram_remainder_and_estimates(spark):
    df = spark.createDataFrame([(i,) for i in range(100)] + [(None,)], "k int")
    h = stats.histogram(df, "k", 32).orderBy("bucket").collect()
    assert [r["count"] for r in h] == [3] * 33 + [1] and h[-1].low == 99
    assert stats.column_estimate("a", {"a": 5}, 9, 3, False) == (5, True)
    assert stats.column_estimate("z", {"a": 5}, 9, 1, False) == (0, True)
    assert stats.column_estimate("z", {"a": 5}, 9, 3, True) == (2, False)
    assert stats.range_estimate([0, 10, 20], [4, 4], 5, 20) == 6
    assert stats.recall_at([(32, 0.8), (64, 0.9)], 48) == np.float64(0.8500000000000001) or abs(stats.recall_at([(32, 0.8), (64, 0.9)], 48) - 0.85) < 1e-9
    assert stats.graph_estimate(2, 3, [1.0], 2.0) == 16


def test_percentile_is_nearest_rank(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    assert {r.fraction: r.value for r in stats.percentiles(df, "v", [0.5, 0.95, 1.0]).collect()} == {0.5: 6.0, 0.95: 10.0, 1.0: 10.0}


def test_merkle_proofs():
    members = [f"b{i}" for i in range(7)]
    root = lifecycle.merkle_root(members)
    assert root == lifecycle.merkle_root(members[::-1])
    assert all(lifecycle.merkle_verify(m, lifecycle.merkle_proof(members, m), root) for m in members)
    assert not lifecycle.merkle_verify("zz", lifecycle.merkle_proof(members, "b1"), root)


def test_commit_is_all_or_nothing(spark):
    held = spark.createDataFrame([("x",)], "b string")
    c = spark.createDataFrame([("x", ["e"], "0.9"), ("y", ["e"], "0.9"), ("z", [], "0.9")], "b string, evidence array<string>, confidence string")
    v = lifecycle.validation(c, held, "b", "evidence")
    assert {r.b: r.status for r in v.collect()} == {"x": "duplicate", "y": "validated", "z": "rejected"}
    assert lifecycle.commit(v).count() == 0 and ids(lifecycle.commit(v.where("b <> 'z'")), "b") == ["y"]


def test_reconcile_keeps_additions_and_removals(spark):
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "k string")
    assert ids(lifecycle.reconcile(one("a", "b", "c"), one("a", "c", "n"), one("a", "b", "m"), "k"), "k") == ["a", "m", "n"]
    assert ids(lifecycle.reconcile(one("a"), one("a", "n"), one("a", "n"), "k"), "k") == ["a", "n"]


def test_intent_rules():
    q = planner.Query
    assert planner.classify(q("sha256:" + "0" * 64)) == "exact"
    assert planner.classify(q("", filters={"subject": "x"})) == "navigational"
    assert planner.classify(q("waves", depth=1)) == "associative"
    assert planner.classify(q("qwe rty"), unseen=0.9) == "semantic"
    assert planner.classify(q("how waves move")) == "semantic"
    assert planner.classify(q("wave energy")) == "lexical" and planner.classify(q("")) == "hybrid"
    assert planner.classify(q("anything", mode="exact")) == "exact"


def test_planner_crossover_and_invariants():
    small, large = planner.Statistics(blocks=4, postings=40, vectors=4), planner.Statistics(blocks=100_000, postings=1_000_000, vectors=100_000)
    assert planner.choose(planner.Query("wave energy"), small)[1].generators == ("seq",)
    assert planner.choose(planner.Query("wave energy"), large)[1].generators != ("seq",)
    assert any("vector" in p.generators for p in planner.choose(planner.Query("wave energy"), large)[2])
    kind, taken, plans = planner.choose(planner.Query("wave energy"), STATS)
    assert taken.objective == min(p.objective for p in plans if p.feasible)
    assert planner.choose(planner.Query("wave", mode="exact"), STATS)[1].generators == ("seq",)
    told = planner.explain(planner.Query("wave energy"), STATS)
    assert told["intent"] == kind and told["frontier"]
    assert planner.damped_union([50, 50]) == 80 and planner.damped_conjunction([0.25, 0.5]) == 0.25 * 0.5**0.5


def test_search_is_the_same_for_any_partitioning(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"wave energy number {i % 3}" if i % 2 else "other text", "s", "en") for i in range(40)], "doc_id long, text string, source string, lang string")
    got = []
    for n in (1, 7):
        ix = indices.IndexSet.build(spark, *adapt.documents(docs.repartition(n)), str(tmp_path / str(n)))
        got.append(search.Engine(ix).search(planner.Query("wave energy")).bundle.orderBy("rank").collect())
    assert got[0] == got[1] and len(got[0]) == 10


def test_directory_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# x")
    (tmp_path / "sub" / "b.txt").write_text("y" * 50)
    (tmp_path / ".hidden").write_text("z")
    got = {r.title: r.media_type for r in files.directory(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "text/markdown", "b.txt": "text/plain"}
    assert [r.title for r in files.directory(spark, str(tmp_path), most_bytes=10).collect()] == ["a.md"]


def test_stream_keeps_the_index_without_repeats(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    for n in range(2):
        spark.createDataFrame([(1, "a"), (2 + n, "b")], "id int, t string").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("id int, t string").parquet(str(source))
        events.maintain(stream, "id", str(target), str(tmp_path / "ck")).awaitTermination(60)
    assert ids(spark.read.parquet(str(target))) == [1, 2, 3]
    assert os.path.isdir(target)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    a = lexical.analysed(docs)
    assert lexical.term_scan(a, "wave").count() == 0 and lexical.seq_scan(docs, "wave").count() == 0
    assert lexical.out_of_vocabulary(a, "wave").first().ratio == 0
    assert stats.histogram(docs, "doc_id").count() == 0


def nearest(x, k):
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, 1, kind="stable")[:, :k]


def test_lsh_recall_over_all_rows(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = e.toPandas().sort_values("vec_id")
    ids, true = rows.vec_id.to_numpy(), nearest(np.stack(rows.embedding).astype(float), 10)
    got = vector.lsh_search(e, e, 10).toPandas()
    assert not got.duplicated(["q", "id"]).any() and not got.duplicated(["q", "rank"]).any()
    found = got.groupby("q")["id"].apply(set)
    assert np.mean([len(found.get(ids[i], set()) & set(ids[true[i]].tolist())) / 10 for i in range(len(ids))]) >= 0.9


def test_cosine_join_meets_every_row_in_any_blocks(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(vector, "PART", 70)
    monkeypatch.setattr(vector, "SLICE", 90)
    got = vector.cosine_join(df, df, 5).toPandas().sort_values(["q", "rank"])
    assert (got["id"].to_numpy().reshape(300, 5) == nearest(x, 5)).all()


def test_registered_vector_queries_take_the_stated_rows(spark):
    from tesserae.catalogue import QUERIES

    got = QUERIES["lsh_ann"](spark, "/root/testdata/sf0.1")
    assert got.select("q").distinct().count() == 40
    curve = {r.effort: r.recall for r in QUERIES["recall_curve"](spark, "/root/testdata/sf0.1").collect()}
    assert curve[8] < curve[16] < curve[32] and curve[16] >= 0.9
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = e.where("vec_id % 50 = 0")
    assert curve[8] == vector.recall(vector.cosine_join(e, asked, 10), vector.lsh_search(e, asked, 10, tables=8), 10).first()[0]
