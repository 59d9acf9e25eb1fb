import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import recall
from engram.operators.ann import GraphIndex, build, nearest_graph, search


def rows(n, dims, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(40, dims))[rng.integers(40, size=n)] + 0.9 * rng.normal(size=(n, dims))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_cost_grows_slower_than_rows():
    """Nine of ten at every size; from 4,000 rows on below a tenth of the rows."""
    costs = []
    for n in (500, 2000, 8000):
        x = rows(n, 24)
        asked = x[:: n // 100]
        exact = np.argsort(-(asked @ x.T), axis=1)[:, :10]
        found, like, cost = search(x, build(x), asked, 24)
        assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, found[:, :10])]) >= 0.9
        assert np.allclose(like[0], x[found[0]] @ asked[0], atol=1e-5) and (np.diff(like, axis=1) <= 0).all()
        costs.append(cost.mean())
    assert costs[2] < 800 and costs[1] < 2 * costs[0] and costs[2] < 2 * costs[1]


def test_small_and_repeated_vectors():
    for n in (1, 2, 3, 40):
        x = np.tile(rows(1, 8), (n, 1))
        found, like, cost = search(x, build(x), x[:1], 24)
        assert set(found[0][found[0] >= 0]) <= set(range(n)) and cost[0] <= n and like[0, 0] > 0.99


def test_index_follows_its_journal(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(GraphIndex, "SHARD", 300)
    x = rows(1000, 16, 3)
    v = spark.createDataFrame([(k, e.tolist()) for k, e in enumerate(x)], "id long, embedding array<double>")
    log = v.select(F.col("id").alias("seq"), "id")
    index = GraphIndex(spark, str(tmp_path / "i"), 16, "p")
    with pytest.raises(RuntimeError):
        index.table()
    assert index.sync(v, log) == {"rebuild": True, "built": 4, "checkpoint": 999}
    assert index.sync(v, log)["built"] == 0
    q = v.filter("id % 50 = 0")
    exact = recall.nearest_each(v, q, 10)
    found = nearest_graph(index, v, q, 10)
    assert recall.overlap_at_k(exact, found).agg(F.avg("recall")).first()[0] >= 0.9
    assert found.agg(F.max("cost")).first()[0] < 1000
    # one vector is another's now, one is gone: two shards at most are built
    moved = v.filter("id != 7").withColumn("embedding", F.when(F.col("id") == 50, F.lit(x[0].astype(float).tolist())).otherwise(F.col("embedding")))
    log2 = log.union(spark.createDataFrame([(1000, 7), (1001, 50)], "seq long, id long"))
    assert index.sync(moved, log2)["built"] <= 2
    held = {i for r in index.table().collect() for i in np.frombuffer(r["ids"], "<i8")}
    assert held == set(range(1000)) - {7}
    assert {r["id"] for r in nearest_graph(index, moved, moved.filter("id = 0"), 2).collect()} == {0, 50}
    # another provider, a journal that starts anew, and growth lead to a rebuild
    assert GraphIndex(spark, str(tmp_path / "i"), 16, "other").sync(v, log)["rebuild"]
    assert index.sync(v, log.filter("seq < 5"))["rebuild"]
    more = v.union(v.select(F.col("id") + 1000, "embedding")).union(v.select(F.col("id") + 2000, "embedding"))
    assert index.sync(more, more.select(F.col("id").alias("seq"), "id"))["built"] == 10
    with pytest.raises(Exception, match="finite"):
        GraphIndex(spark, str(tmp_path / "z"), 16, "p").sync(v.withColumn("embedding", F.transform("embedding", lambda e: e * 0)), log)


def test_indexes_follow_their_tables(spark, sf, tmp_path):
    """A table that changes between two queries is answered from as it is."""
    from engram.plans import catalog, catalog_new

    shutil.copy(f"{sf}/embeddings.parquet", tmp_path)
    shutil.copy(f"{sf}/documents.parquet", tmp_path)
    folder = str(tmp_path)
    names = ("ann_topk", "lexical_bm25")
    before = {n: set(map(tuple, catalog.QUERIES[n](spark, folder).collect())) for n in names}
    first = catalog_new.graph_index(spark, folder)
    assert catalog_new.graph_index(spark, folder) is first
    for t, key in (("embeddings", "vec_id"), ("documents", "doc_id")):
        kept = spark.createDataFrame(spark.read.parquet(f"{folder}/{t}.parquet").filter(F.col(key) % 3 != 0).toPandas())
        kept.coalesce(1).write.parquet(f"{folder}/new-{t}")
        (tmp_path / f"{t}.parquet").unlink()
        shutil.move(next((tmp_path / f"new-{t}").glob("*.parquet")), tmp_path / f"{t}.parquet")
    after = {n: set(map(tuple, catalog.QUERIES[n](spark, folder).collect())) for n in names}
    assert after["ann_topk"] != before["ann_topk"] and all(r[1] % 3 for r in after["ann_topk"])
    assert after["lexical_bm25"] != before["lexical_bm25"] and all(int(r[0]) % 3 for r in after["lexical_bm25"])
    assert catalog_new.graph_index(spark, folder) is not first


def copied(spark, n, copies, dims=16):
    """``copies`` rows of each of n vectors."""
    x = rows(n, dims, 5)
    return spark.createDataFrame([(k, x[k % n].tolist()) for k in range(n * copies)], "id long, embedding array<double>")


def test_copies_crowd_nothing_out_of_coded_vectors(spark, tmp_path):
    v = copied(spark, 30, 60)
    q = v.filter("id % 100 = 0")
    index = recall.VectorIndex(spark, str(tmp_path / "i"), 16, "p")
    index.sync(v, v.select(F.col("id").alias("seq"), "id"))
    found = lambda df: {(r["query"], r["rank"]): r["id"] for r in df.collect()}
    assert found(recall.nearest_approx(index, v, q, 10)) == found(recall.nearest_each(v, q, 10))


def test_near_ties_of_coded_vectors(spark, tmp_path):
    """200 vectors that codes can't tell from one another: the nearest are found all the same."""
    rng = np.random.default_rng(1)
    x = np.ones(16) + 1e-4 * rng.normal(size=(200, 16))
    v = spark.createDataFrame([(k, e.tolist()) for k, e in enumerate(x)], "id long, embedding array<double>")
    index = recall.VectorIndex(spark, str(tmp_path / "i"), 16, "p")
    index.sync(v, v.select(F.col("id").alias("seq"), "id"))
    found = lambda df: {(r["query"], r["rank"]): r["id"] for r in df.collect()}
    assert found(recall.nearest_approx(index, v, v.filter("id < 5"), 5)) == found(recall.nearest_each(v, v.filter("id < 5"), 5))


def test_graph_of_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(GraphIndex, "SHARD", 300)
    v = copied(spark, 50, 20)
    index = GraphIndex(spark, str(tmp_path / "i"), 16, "p")
    index.sync(v, v.select(F.col("id").alias("seq"), "id"))
    q = v.filter("id % 37 = 0")
    assert recall.overlap_at_k(recall.nearest_each(v, q, 10), nearest_graph(index, v, q, 10)).agg(F.avg("recall")).first()[0] >= 0.9
    first = nearest_graph(index, v, q, 10, own_first=True).filter("rank = 1 AND query = id")
    assert first.count() == q.count()


def indexed(spark, folder, x):
    """Rows of x, and an index of them."""
    v = spark.createDataFrame([(k, e.tolist()) for k, e in enumerate(x)], "id long, embedding array<double>")
    index = GraphIndex(spark, folder, x.shape[1], "p")
    index.sync(v, v.select(F.col("id").alias("seq"), "id"))
    return v, index


def test_stored_vectors_are_found_wherever_they_stand(spark, tmp_path):
    """No link leads from one of two far groups to the other; each row finds itself all the same."""
    rng = np.random.default_rng(2)
    x = 0.1 * rng.normal(size=(400, 8))
    x[:, 0] += np.where(np.arange(400) < 200, 1, -1)
    v, index = indexed(spark, str(tmp_path / "i"), x)
    first = nearest_graph(index, v, v, 10, own_first=True).filter("rank = 1 AND query = id")
    assert first.count() == 400


def test_shards_fit_their_beams(spark, tmp_path, monkeypatch):
    """Vectors of no clusters, most queries not in a shard: nine of ten at less than half the rows."""
    monkeypatch.setattr(GraphIndex, "SHARD", 2000)
    x = np.random.default_rng(4).normal(size=(6000, 64))
    v, index = indexed(spark, str(tmp_path / "i"), x)
    q = v.filter("id % 100 = 0")
    found = nearest_graph(index, v, q, 10)
    assert recall.overlap_at_k(recall.nearest_each(v, q, 10), found).agg(F.avg("recall")).first()[0] >= 0.9
    assert found.groupBy("query").agg(F.max("cost").alias("cost")).agg(F.avg("cost")).first()[0] < 3000
