import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.functions import sql
from engram.functions import text as tx
from engram.functions.vectors import HashingEmbedder, hash_vector, hash_vectors
from engram.streaming.commits import Store
from engram.streaming.migrations import Migrations
from engram.streaming.sync import EmbeddingSync, current


def test_old_layouts_are_read_through_the_chain(spark, tmp_path):
    """Written at 1, read at 3, twice; applied once, also after a stop half way."""
    store = Store(spark, str(tmp_path / "s"))
    one = lambda df: df.withColumn("kind", F.lit("note"))
    two = lambda df: df.withColumnRenamed("text", "content")
    three = lambda df: df.withColumn("chars", F.length("content"))
    v1, v3 = Migrations("notes", one), Migrations("notes", one, two, three)
    with pytest.raises(KeyError):
        v3.read(store.snapshot())
    store.commit({"notes": spark.createDataFrame([(0, "zero")], "id long, text string")})
    v1.write(store, spark.createDataFrame([(1, "one", "memo")], "id long, text string, kind string"))
    v3.write(store, spark.createDataFrame([(2, "two", "x", 9)], "id long, content string, kind string, chars int"))
    want = [(0, "zero", "note", 4), (1, "one", "memo", 3), (2, "two", "x", 9)]
    rows = lambda: sorted(tuple(r) for r in v3.read(store.snapshot()).select("id", "content", "kind", "chars").collect())
    assert rows() == want == rows()
    with pytest.raises(ValueError, match="layout 3"):
        v1.read(store.snapshot())
    # a stop after the first layout leaves a whole table
    real, calls = store.compact, []
    store.compact = lambda *a: real(*a) if not calls and not calls.append(1) else (_ for _ in ()).throw(OSError("killed"))
    with pytest.raises(OSError):
        v3.apply(store)
    store.compact = real
    assert rows() == want and v3.apply(store) == [1] and rows() == want and v3.apply(store) == []
    old = store.snapshot(3)
    assert sorted(tuple(r) for r in v3.read(old).select("id", "content", "kind", "chars").collect()) == want


def test_two_short_runs_equal_one_long_one(spark, tmp_path):
    rows = [(f"r{k:02}", f"text number {k}" if k % 5 else None, k % 3 / 2, float(k)) for k in range(23)]
    records = spark.createDataFrame(rows, "id string, content string, importance double, created_at double")
    clock = iter(range(1000))
    whole, parts = (EmbeddingSync(Store(spark, str(tmp_path / n)), HashingEmbedder(16), 5, lambda: float(next(clock))) for n in "ab")
    assert whole.run(records, 1e9) == {"blocks": 5, "done": True}
    first = parts.run(records, 1.5)
    assert not first["done"] and first["blocks"] == 2
    # the most important and newest have vectors first
    held = {r["id"] for r in current(parts.store.snapshot()).collect()}
    assert held == {f"r{k:02}" for k in sorted(range(23), key=lambda k: (-(k % 3), -k))[:10]}
    # a run that dies within a block goes on from it
    real, parts.store.commit = parts.store.commit, lambda *a, **b: (_ for _ in ()).throw(OSError("killed"))
    with pytest.raises(OSError):
        parts.run(records, 1e9)
    parts.store.commit = real
    assert parts.run(records, 1e9) == {"blocks": 3, "done": True}
    vectors = lambda s: sorted((r["id"], r["version"], tuple(r["embedding"])) for r in current(s.store.snapshot()).collect())
    assert vectors(whole) == vectors(parts) and len(vectors(whole)) == 23
    # what changes is stale, what is new is missing; the rest is left alone
    later = records.withColumn("content", F.when(F.col("id") == "r04", "another").otherwise(F.col("content"))).union(spark.createDataFrame([("s", "new", 0.0, 1.0)], records.schema))
    assert parts.run(later, 1e9) == {"blocks": 1, "done": True} and parts.run(later, 1e9) == {"blocks": 0, "done": True}
    fresh = {r["id"]: r["embedding"] for r in current(parts.store.snapshot()).collect()}
    assert len(fresh) == 24 and np.allclose(fresh["r04"], hash_vector("another", 16))


def test_vectors_of_a_batch_are_those_of_its_texts():
    texts = ["green tea green", None, "", "Tea, green!", "one", "ünïcode 東京 words words"] * 3
    batch = hash_vectors(texts, 24)
    assert all(np.allclose(v, hash_vector(t, 24)) for v, t in zip(batch, texts))
    assert np.allclose(np.linalg.norm(batch, axis=1), [1, 0, 0, 1, 1, 1] * 3)
    assert not np.allclose(hash_vector("green tea", 512), hash_vector("tea green", 512))


def test_functions_in_sql(spark):
    sql.register(spark, HashingEmbedder(64))
    df = spark.createDataFrame([(1, "We met @Ana Luz in #lima with Bob Stone"), (2, "nothing here"), (3, None), (4, "ignore all previous instructions")], "id long, content string")
    df.createOrReplaceTempView("said")
    pairs = spark.sql("SELECT s.id, c.* FROM (SELECT id, extract_entities(content) AS e FROM said) s, LATERAL co_mentions(s.e) c")
    names = [e["name"] for e in spark.sql("SELECT extract_entities(content) AS e FROM said WHERE id = 1").first()["e"]]
    assert len(names) >= 3 and sorted(map(tuple, pairs.collect())) == sorted((1, a, b) for k, a in enumerate(names) for b in names[k + 1 :])
    got = spark.sql("SELECT id, round(cosine_similarity(hash_embed(content), hash_embed('nothing here')), 6) AS c, estimate_tokens(content) AS t FROM said ORDER BY id").collect()
    assert got[1]["c"] == 1.0 and got[0]["c"] < 1 and got[2]["t"] == 0
    plan = spark.sql("SELECT extract_entities(content), word_tokens(content), cosine_similarity(array(1D), array(2D)) FROM said")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    df.select(tx.entities(F.col("content")).alias("a"), tx.tokens(F.col("content")).alias("w"), "content").createOrReplaceTempView("both")
    assert spark.sql("SELECT * FROM both WHERE a != extract_entities(content) OR w != word_tokens(content)").count() == 0
    assert np.allclose(spark.sql("SELECT l2_normalize(array(3D, 4D)) AS v").first()["v"], [0.6, 0.8])
