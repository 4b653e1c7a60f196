"""What larger tables and longer texts showed: plans as the SQL states, batches that hold little."""

import random
from collections import Counter

import pyarrow as pa
import regex

from tesserae.functions import ingest, scoring, text
from tesserae.operators import adapt, indices, lexical, vector
from tesserae.plans import ingest as intake
from tesserae.plans import planner, search


def test_the_crossover_counts_blocks_whatever_their_length():
    asked = planner.Query("the thing and they hared")
    for postings in (200, 900):  # a block
        for blocks, generators in ((13_000, ("seq",)), (13_001, ("term", "vector"))):
            stats = {"semantic": planner.Statistics(blocks, blocks * postings, blocks, edges=blocks, degree=1.0)}
            _, plan, plans = planner.choose(asked, stats, crossover=13_000)
            assert plan.generators == generators and plan.pool == 40 and plan in plans
    assert planner.choose(asked, stats)[1].generators == ("seq",)  # by costs: long texts make the scan the cheaper one
    # without a plan on that side the best of the others is taken
    listing = planner.Query("", planner.Filters(tags=("x",)))
    assert planner.choose(listing, stats, crossover=13_000)[1].generators == ("seq",)


def texts(n, words):
    r = random.Random(3)
    return [" ".join(f"w{r.randrange(500)}" for _ in range(words)) for _ in range(n)]


def tokens_of(t):
    return [w for w in regex.findall(text.TOKEN, t.lower()) if len(w) >= 2]


def test_postings_come_in_batches_of_few_words():
    made = texts(3000, 200)
    one = lambda t: [{"weight": 3.0, "text": "of all"}, {"weight": 1.0, "text": t}]
    fields = pa.array([*map(one, made), None, []], pa.list_(pa.struct([("weight", pa.float64()), ("text", pa.string())])))
    n = len(fields)
    b = pa.RecordBatch.from_arrays([pa.array(range(n)), fields], names=["block_id", "fields"])
    got = list(indices._postings([b.slice(0, 0), b]))
    assert len(got) > 3 and max(sum(x.column("occurrences").to_pylist()) for x in got) <= text.TOKENS + 202
    stored = pa.Table.from_batches(got).to_pylist()
    rows = [{"term": r["term"]} | h for r in stored for h in r["held"]]
    for k in (0, 1700, 2999):
        held = {r["term"]: r for r in rows if r["block_id"] == k}
        found = tokens_of(made[k])
        places = {t: [i + 3 for i, x in enumerate(found) if x == t] for t in found} | {"of": [0], "all": [1]}
        assert {t: r["places"] for t, r in held.items()} == places
        assert all(r["tf"] == (3000 if t in ("of", "all") else 1000 * len(places[t])) and r["length"] == len(found) + 2 for t, r in held.items())
    assert sum(r["documents"] for r in stored) == 3000 and sum(r["length"] for r in stored) == 3000 * 202
    assert all(r["occurrences"] == sum(len(h["places"]) for h in r["held"]) for r in stored)


def test_counts_and_vectors_come_in_batches_of_few_words():
    made = [tokens_of(t) for t in texts(2000, 200)] + [[], ["w1"] * (text.TOKENS + 5)]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(made))), pa.array(made, pa.list_(pa.string()))], names=["id", "tokens"])
    counted = list(lexical._counted([b, b.slice(0, 0)]))
    assert len(counted) > 3 and max(sum(x.column("tf").to_pylist()) for x in counted) <= text.TOKENS + 5
    want = Counter((w, i) for i, words in enumerate(made) for w in words)
    assert {(r["term"], r["id"]): r["tf"] for r in pa.Table.from_batches(counted).to_pylist()} == want
    sparse = list(vector._sparse([b], 256))
    assert len(sparse) > 3
    rows = pa.Table.from_batches(sparse).to_pylist()
    for k in (5, 1999, 2001):
        raw = Counter()
        for w in made[k]:
            bucket, sign = scoring.hashed(w)
            raw[bucket] += sign
        norm = sum(x * x for x in raw.values()) ** 0.5
        got = {r["bucket"]: r["value"] for r in rows if r["id"] == k}
        assert got.keys() == {i for i, x in raw.items() if x} and all(abs(x - raw[i] / norm) < 1e-12 for i, x in got.items())


def test_tokens_are_those_of_the_pattern():
    r = random.Random(1)
    for _ in range(5000):
        t = "".join(r.choice("ab_ _\xa0\x85\x1c²½ßñÉ9İʼ一́-'\n") for _ in range(r.randrange(12)))
        assert text.analyse(t) == tokens_of(t)


def test_values_are_mapped_some_at_a_time(spark):
    made = text.sliced(lambda a, b: None if a is None else [{"n": len(a), "t": a * b}], "array<struct<n:int,t:string>>")
    rows = spark.createDataFrame([(i, None if i == 7 else str(i), i % 3) for i in range(1000)], "id int, a string, b int").coalesce(1)
    got = {r.id: r.x for r in rows.select("id", made("a", "b").alias("x")).collect()}
    assert got[7] is None and all(got[i][0] == (len(str(i)), str(i) * (i % 3)) for i in range(1000) if i != 7)


def test_vectors_are_made_once(spark):
    rows = spark.createDataFrame([(1, "wave energy"), (2, "- -"), (3, None)], "id int, t string")
    got = vector.with_vectors(rows, "t", "v").collect()
    assert [(r.id, r.v) for r in got] == [(1, search.query_vector("wave energy"))]


def test_a_run_proposes_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def counting(views):
        def each(parts):
            for b in parts:
                asked.add(b.num_rows)
                yield b

        return ingest.proposals(views.mapInArrow(each, views.schema))

    data = [f"# One\nbody {i}\n".encode() for i in range(5)]
    items = spark.createDataFrame([(f"o{i}", "text/markdown", f"sha256:{i}", bytearray(x)) for i, x in enumerate(data)], "origin string, media_type string, digest string, data binary")
    none = spark.createDataFrame([], "block_id string, label string, statement string")
    intake.PROPOSERS["counting"] = counting
    try:
        done = intake.run(spark, items, none.select("block_id"), none, intake.Task("o", proposer="counting"))
        assert done.committed.count() == 5 and done.counts["validated"] == 5 and asked.value == 5
    finally:
        del intake.PROPOSERS["counting"]


def test_rows_with_their_stored_form_build_the_same_set(spark, tmp_path):
    docs = spark.createDataFrame([(1, "wave of energy", "s", "en"), (2, None, "s", "en"), (3, "- -", None, "de"), (4, "energy wave", "u", None)], "doc_id long, text string, source string, lang string")
    a = indices.IndexSet.build(spark, *adapt.documents(docs), str(tmp_path / "a"), chunked=False)
    b = indices.IndexSet.build(spark, adapt.whole_documents(docs), None, str(tmp_path / "b"), chunked=False)
    for t in indices.TABLES:
        assert sorted(map(repr, a[t].select(sorted(a[t].columns)).collect())) == sorted(map(repr, b[t].select(sorted(a[t].columns)).collect())), t
    assert b["meta"].first().documents == 2 and b["postings"].where("places is null").count() * 2 == b["postings"].count()
    assert indices.IndexSet.build(spark, adapt.whole_documents(docs), None, str(tmp_path / "b"), chunked=False).name == b.name
