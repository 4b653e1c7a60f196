"""Statistics, vectors and cached embeddings that outlive a session."""

import pytest
from pyspark.sql import functions as F

from tesserae.functions import scoring
from tesserae.operators import adapt, indices, travel, vector
from tesserae.plans.planner import Statistics


def test_statistics_come_back_and_tell_their_age(spark, tmp_path):
    folder = str(tmp_path / "s")
    stats = {"semantic": Statistics(5, 50, 5, curve=((32, 0.8), (64, 0.9)), subjects=(("a", 3),)), "episodic": Statistics(2)}
    assert travel.load_statistics(spark, folder, "semantic") is None and travel.freshness(None, "r", "f") == "absent"
    travel.save_statistics(spark, folder, stats, "r", "f")
    held = travel.load_statistics(spark, folder, "semantic")
    assert held["figures"] == stats["semantic"]
    assert travel.freshness(held, "r", "f") == "fresh" and travel.freshness(held, "r", "g") == "stale" and travel.freshness(held, "q", "f") == "stale"
    broken = next((tmp_path / "s" / "memory_type=episodic").glob("*.txt"))
    broken.write_text("{")
    (broken.parent / f".{broken.name}.crc").unlink(missing_ok=True)
    assert travel.load_statistics(spark, folder, "episodic") is None
    assert travel.merged({"df": 1, "n": 2}, {"df": 3, "module": {"n": 9}}, {"x": 1}) == {"df": 3, "n": 9, "x": 1}


def test_vectors_travel_with_their_model(spark, tmp_path):
    docs = spark.createDataFrame([(1, "wave energy", "s", "en")], "doc_id long, text string, source string, lang string")
    ix = indices.IndexSet.build(spark, *adapt.documents(docs), str(tmp_path / "ix"))
    tag = {"model": indices.MODEL, "dims": 256, "space": "text"}
    travel.dump_vectors(ix, str(tmp_path / "v"), tag)
    assert travel.load_vectors(spark, str(tmp_path / "v"), tag).count() == 1
    with pytest.raises(travel.Mismatch, match="dims"):
        travel.load_vectors(spark, str(tmp_path / "v"), tag | {"dims": 384})
    none = indices.IndexSet.build(spark, *adapt.documents(docs.limit(0)), str(tmp_path / "empty"))
    with pytest.raises(ValueError, match="no vectors"):
        travel.dump_vectors(none, str(tmp_path / "w"), tag)


def test_cache_embeds_once_and_is_vacuumed(spark, tmp_path):
    cache = travel.EmbeddingCache(spark, str(tmp_path))
    texts = spark.createDataFrame([("wave",), ("tide",), ("wave",)], "text string")
    key = scoring.cache_key(F.lit("hashing"), F.lit("text"), F.lit("passage"), F.col("text"))
    wanted = texts.select(key.alias("key"), "text")
    assert cache.rows().count() == 0 and cache.embed(wanted, vector.hashed_vectors).count() == 3 and cache.rows().count() == 2
    never = lambda c: F.raise_error(F.lit("embedded again")).cast("array<double>")
    assert cache.embed(wanted, never).count() == 3
    cache.vacuum(wanted.where("text = 'tide'"))
    assert cache.rows().count() == 1
