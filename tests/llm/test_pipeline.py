"""The pipeline and the driver's contract."""

import corpus_pipeline
import numpy as np

import __spark_entry__
from tesserae.llm import registry


def write(spark, folder, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_stages_take_effect(spark, tmp_path):
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice([f"w{i}" for i in range(300)], 60)) for _ in range(60)]
    bad = ["$$$ ### !!! 99 BUY " * 8 + str(i) for i in range(30)]
    body = good + bad + [good[0], good[0], good[1] + " extra", None, ""]
    docs = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(body)]
    write(spark, str(tmp_path), docs, [(i, int(i < 60), 0) for i in range(90)])
    frame, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        seen[name] = [r.doc_id for r in out.collect()]
        if name != "packing":
            assert out.columns == frame.columns
        frame = out
    assert set(range(60)) <= set(seen["quality"]) and not set(range(60, 90)) & set(seen["quality"])
    assert not {90, 91} & set(seen["exact_dedup"]) and 92 in seen["exact_dedup"]
    assert 92 not in seen["near_dedup"] and 1 in seen["near_dedup"]
    assert set(seen["mixing"]) < set(seen["near_dedup"]) and set(seen["packing"]) == set(seen["mixing"])
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(seen["packing"])


def test_stages_against_brute_force(spark, tmp_path):
    """Every stage but the last on its own input: verdicts by a walk of the trees row by row, copies and near copies by comparing
    all pairs; odd rows, a table without rows and a clashing column among them."""
    from test_dedup import near_brute

    from tesserae.llm import near_dup, quality

    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(200)]
    good = [" ".join(rng.choice(vocabulary, 50)) for _ in range(40)]
    near = [t + " tail" for t in good[:10]]
    bad = ["$$$ ### !!! 99 BUY " * 8 + str(i) for i in range(20)]
    body = good + near + good[:5] + bad + [None, "", "same", "same", "word " * 20_000]
    rows = [(i if i % 9 else None if i == 63 else i, t, "en", f"s{i % 2}", len(t or ""), 1) for i, t in enumerate(body)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `__row` int"
    spark.createDataFrame([*rows, rows[0]], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(75)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    key = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    forest = quality.train(frame, spark.read.parquet(f"{tmp_path}/labels.parquet"))

    def accepted(text):
        x, margin = quality.matrix([text])[0], forest.base
        for t in range(len(forest.value)):
            node = 0
            for _ in range(forest.depth):
                node = 2 * node + 1 + int(x[forest.feature[t, node]] > forest.threshold[t, node])
            margin += forest.value[t, node - (forest.value.shape[1] - 1)]
        return margin >= 0

    kept = stages["quality"](spark, frame, str(tmp_path))
    assert key(kept) == sorted(((r.doc_id, r.text) for r in frame.collect() if accepted(r.text)), key=repr)
    once = stages["exact_dedup"](spark, kept, str(tmp_path))
    first = {}
    for r in kept.collect():
        at = (r.doc_id is None, r.doc_id)
        first[r.text] = min(first.get(r.text, at), at) if r.text is not None else None
    assert sorted(t for t in (r.text for r in once.collect()) if t is not None) == sorted(t for t in first if t is not None)
    assert all((r.doc_id is None, r.doc_id) == first[r.text] for r in once.collect() if r.text is not None)
    numbered = [(r.doc_id, r.text) for r in once.collect() if r.doc_id is not None]
    _, stay = near_brute(numbered, near_dup.THRESHOLD, near_dup.NGRAM)
    few = stages["near_dedup"](spark, once.where("doc_id is not null"), str(tmp_path))
    assert {r.doc_id for r in few.collect()} == stay
    mixed = stages["mixing"](spark, few, str(tmp_path))
    packed = stages["packing"](spark, mixed, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0, name


def test_contract(spark):
    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(known) and "pipeline" in known
    assert [sum(k.startswith(f"op{n}_") for k in known) for n in range(1, 11)] == [1] * 10
    assert set(registry.SQL) <= set(registry.QUERIES) and all(isinstance(x, str) for x in sql.values())
