"""Registered queries of the graph index, elimination in order, streams and commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql
from ..functions.vectors import HashingEmbedder
from ..operators import ann, elimination, recall
from ..sources import session_logs, views
from ..sources.tail import LogTail
from ..storage import fresh_folder
from ..streaming import ingest, state
from ..streaming.commits import Store
from ..streaming.migrations import Migrations
from ..streaming.sync import EmbeddingSync, current
from . import engines
from .catalog import _MEM, _NEG, _TALK, _TOP, _index, _journal, query


def graph_index(spark, sf) -> ann.GraphIndex:
    """The written proximity graph of all vectors."""
    def make(root: str) -> ann.GraphIndex:
        v = views.vectors(spark, sf)
        index = ann.GraphIndex(spark, root, len(v.first()["embedding"]), "table")
        index.sync(v, _journal(v))
        return index

    return _index("graph", spark, sf, "embeddings", make)


# recall is held against exact search; below some thousand rows a search still meets
# a good part of its shard, so the cost asserted here is that of half the rows
@query("graph_recall", "SELECT count(*) AS queries, true AS reached, true AS cheaper FROM embeddings WHERE vec_id % 100 = 0")
def graph_recall(spark, sf):
    """Queries, whether they found nine of ten, and whether they met less than half the rows."""
    v = views.vectors(spark, sf)
    q = v.filter("id % 100 = 0")
    found = ann.nearest_graph(graph_index(spark, sf), v, q, 10).cache()
    each = recall.overlap_at_k(recall.nearest_each(v, q, 10), found)
    cost = found.groupBy("query").agg(F.max("cost").alias("cost"))
    rows = v.agg(F.count("*").alias("rows"))
    met = cost.crossJoin(F.broadcast(rows)).agg((2 * F.sum("cost") < F.sum("rows")).alias("cheaper"))
    return each.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("reached")).crossJoin(met)


@query("graph_changed", "SELECT CASE WHEN vec_id % 10 = 3 THEN 'gone' ELSE 'found' END AS state, count(*) AS n FROM embeddings WHERE vec_id % 100 IN (0, 3) GROUP BY 1")
def graph_changed(spark, sf):
    """Rows that find themselves first, after a journal took the ids that end in 3 away."""
    v = views.vectors(spark, sf)
    index = ann.GraphIndex(spark, fresh_folder(spark, "graph"), len(v.first()["embedding"]), "table")
    index.sync(v, _journal(v))
    left = v.filter("id % 10 != 3")
    later = v.filter("id % 10 = 3").select((F.col("id") + v.count()).alias("seq"), "id")
    index.sync(left, _journal(v).unionByName(later))
    asked = v.filter("id % 100 IN (0, 3)")
    first = ann.nearest_graph(index, left, asked, 10, own_first=True).filter("query = id").select("query")
    both = asked.select(F.col("id").alias("query")).join(first.withColumn("held", F.lit(True)), "query", "left")
    return both.groupBy(F.when(F.col("held"), "found").otherwise("gone").alias("state")).agg(F.count("*").alias("n"))


# times repeat, so that the rules for equal importance and equal time decide, too
@query("janitor_elimination", """
WITH RECURSIVE n AS (SELECT vec_id AS id, (vec_id % 11) / 10.0 AS importance, vec_id % 97 AS at, row_number() OVER (ORDER BY vec_id % 97 DESC, vec_id) AS pos, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.pos, a.id, b.id AS b, CASE WHEN a.importance < b.importance OR (a.importance = b.importance AND a.at <= b.at) THEN a.id ELSE b.id END AS loser
  FROM n a JOIN n b ON a.pos < b.pos AND list_cosine_similarity(a.e, b.e) >= 0.3),
s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY pos) AS k, any_value(id) AS id, list({'b': b, 'loser': loser}) AS xs FROM p GROUP BY pos),
f AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL
  SELECT s.k, CASE WHEN list_contains(gone, s.id) THEN gone ELSE list_distinct(list_concat(gone, list_transform(list_filter(xs, lambda x: NOT list_contains(gone, x.b)), lambda x: x.loser))) END FROM f JOIN s ON s.k = f.k + 1),
g AS (SELECT gone FROM f ORDER BY k DESC LIMIT 1)
SELECT id, list_contains(gone, id) AS removed FROM n, g""")
def janitor_elimination(spark, sf):
    """The ordered pass over the whole table; the vectors have no near copies at 0.97, so
    this one takes those alike at 0.3."""
    v = views.vectors(spark, sf)
    r = v.select("id", (F.col("id") % 11 / 10.0).alias("importance"), (F.col("id") % 97).cast("double").alias("created_at"), "embedding")
    return elimination.eliminate(r, 0.3)


# ---- streams and commits ----------------------------------------------------

_LINES = "SELECT coalesce(role, '') AS role, text FROM conversations WHERE text IS NOT NULL AND length(trim(text)) >= 8"


def _local(folder: str) -> str:
    """The path of a shared folder that the driver and all executors mount."""
    scheme, _, path = folder.rpartition(":")
    if scheme not in ("", "file"):
        raise RuntimeError("log files are tailed in a folder that is mounted everywhere, not in " + folder)
    return "/" + path.lstrip("/")


@query("tail_stream", f"SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars, (SELECT sum(length(text)) FROM ({_LINES}))::BIGINT AS all_chars FROM ({_LINES}) GROUP BY role")
def tail_stream(spark, sf):
    """Session logs of all turns, taken by the byte tail in two runs, the second after
    the files have grown; messages are committed batch by batch."""
    root = fresh_folder(spark, "tail")
    logs, store = _local(f"{root}/logs"), Store(spark, f"{root}/store")
    c = views.table(spark, sf, "conversations")
    line = F.to_json(F.struct(F.lit("message").alias("type"), F.struct(F.coalesce("role", F.lit("")).alias("role"), F.col("text").alias("content")).alias("message")))
    spark.dataSource.register(LogTail)
    for half in (0, 1):
        c.filter(F.pmod("conv_id", F.lit(2)) == half).select(line).write.mode("append").text(f"{root}/logs/{half}")
        told = spark.readStream.format("log_tail").option("path", f"{logs}/*/*.txt").option("cursor", f"{_local(root)}/cursor.json").load()
        said = told.select("path", "start", session_logs.parse(F.col("line")).alias("m")).filter(F.char_length(F.trim("m.text")) >= 8)
        rows = said.select("path", "start", "m.role", F.col("m.text").alias("text"))
        run = rows.writeStream.foreachBatch(lambda d, k: store.commit({"messages": d}, "tail", k)).option("checkpointLocation", f"{root}/checkpoint")
        run.trigger(availableNow=True).start().awaitTermination()
    taken = store.snapshot().table("messages").dropDuplicates(["path", "start"])
    total = taken.agg(F.sum(F.length("text")).alias("all_chars"))
    return taken.groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).crossJoin(F.broadcast(total))


_TTL, _ROOM = 3 * 86400, 5


@query("working_memory", f"""
WITH e AS (SELECT user_id::VARCHAR AS owner, event_id::VARCHAR AS id, epoch(ts)::DOUBLE AS tm, (SELECT max(epoch(ts)) FROM events)::DOUBLE AS now FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY tm DESC, id) AS r FROM e)
SELECT owner, count(*) FILTER (tm + {_TTL} >= now) AS held, coalesce(string_agg(id, ',' ORDER BY r) FILTER (tm + {_TTL} >= now), '') AS ids FROM r WHERE r <= {_ROOM} GROUP BY owner""")
def working_memory(spark, sf):
    """What each user's memory holds of the events at the end of their stream."""
    key, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    root, had = fresh_folder(spark, "working"), spark.conf.get(key, None)
    store = Store(spark, f"{root}/store")
    table = views.table(spark, sf, "events")
    # a stream takes a folder: the table's own, or that of its one file
    alone = all(f.endswith("/events.parquet") for f in table.inputFiles())
    reader = spark.readStream.schema(table.schema)
    events = reader.option("pathGlobFilter", "events.parquet").parquet(sf) if alone else reader.parquet(f"{sf}/events.parquet")
    puts = events.select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    spark.conf.set(key, rocks)
    try:
        told = state.working_memory(puts, float(_TTL), _ROOM)
        run = told.writeStream.foreachBatch(lambda d, k: store.commit({"memory": d}, "memory", k)).outputMode("update").option("checkpointLocation", f"{root}/checkpoint")
        run.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, had) if had is not None else spark.conf.unset(key)
    last = store.snapshot().table("memory").groupBy("owner").agg(F.max_by("ids", "version").alias("ids"))
    return last.select("owner", F.size("ids").cast("long").alias("held"), F.array_join("ids", ",").alias("ids"))


@query("commit_snapshots", """
WITH b AS (SELECT doc_id % 3 AS b, doc_id, lang FROM documents WHERE doc_id IS NOT NULL)
SELECT v.version::INT AS version, t.name, (SELECT count(*) FROM b WHERE b < v.version)::BIGINT AS n, (SELECT count(*) FROM b WHERE b < v.version AND lang IS NOT NULL)::BIGINT AS tagged
FROM (VALUES (1), (2), (3)) v(version), (VALUES ('episodes'), ('vectors')) t(name)""")
def commit_snapshots(spark, sf):
    """Three batches of documents with their vectors and tags, the second sent twice: what
    a reader of each version sees."""
    store = Store(spark, fresh_folder(spark, "store"))
    m = views.table(spark, sf, "documents").filter("doc_id IS NOT NULL").select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.array_compact(F.array("lang")).alias("tags"))
    for k in (0, 1, 1, 2):
        made = ingest.projections(m.filter(F.col("doc_id") % 3 == k).drop("doc_id"), HashingEmbedder(16))
        store.commit({t: made[t] for t in ("episodes", "vectors", "tags")}, "documents", k)
    out = None
    for version in store.versions():
        now = store.snapshot(version)
        tagged = now.table("tags").agg(F.count("*").alias("tagged"))
        for name in ("episodes", "vectors"):
            n = now.table(name).agg(F.count("*").alias("n"))
            row = n.crossJoin(F.broadcast(tagged)).select(F.lit(version).alias("version"), F.lit(name).alias("name"), "n", "tagged")
            out = row if out is None else out.unionByName(row)
    return out


# ---- SQL text ----------------------------------------------------------------


def _registered(spark, **frames) -> None:
    sql.register(spark, HashingEmbedder(64))
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


@query("sql_similar", f"SELECT id, score FROM ({_TOP}) WHERE score >= 0 ORDER BY score DESC, id LIMIT 10")
def sql_similar(spark, sf):
    _registered(spark, engram_vectors=views.vectors(spark, sf))
    return spark.sql("""
        SELECT v.id, round(cosine_similarity(v.embedding, q.embedding), 6) AS score
        FROM engram_vectors v CROSS JOIN (SELECT embedding FROM engram_vectors WHERE id = 0) q
        WHERE cosine_similarity(v.embedding, q.embedding) >= 0 ORDER BY score DESC, id LIMIT 10""")


@query("sql_comentions", f"{_TALK} SELECT source, target, weight FROM edges")
def sql_comentions(spark, sf):
    _registered(spark, engram_turns=views.turns(spark, sf).select(F.col("uuid").alias("id"), F.col("text").alias("content")))
    return spark.sql("""
        SELECT c.source, c.target, cast(count(*) AS DOUBLE) AS weight
        FROM (SELECT id, extract_entities(content) AS e FROM engram_turns) t, LATERAL co_mentions(t.e) c GROUP BY c.source, c.target""")


@query("sql_hash_embed", """
WITH t AS (SELECT lower(coalesce(text, '')) AS t, role FROM conversations)
SELECT role, count(*) AS n, count(*) FILTER (len(regexp_extract_all(t, '[\\p{L}\\p{N}\\p{M}_]+')) > 0) AS embedded FROM t GROUP BY role""")
def sql_hash_embed(spark, sf):
    """Turns, and those whose vector is like itself: all that hold a word."""
    _registered(spark, engram_turns=views.turns(spark, sf))
    return spark.sql("""
        SELECT role, count(*) AS n, count_if(cosine_similarity(v, v) > 0.999999) AS embedded
        FROM (SELECT role, hash_embed(text) AS v FROM engram_turns) GROUP BY role""")


# ---- migrations, resumable work ------------------------------------------------


@query("schema_chain", """
SELECT doc_id % 3 AS written_at, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars, count(*) FILTER (doc_id % 3 > 0 AND lang IS NOT NULL) AS with_lang
FROM documents WHERE doc_id IS NOT NULL GROUP BY 1""")
def schema_chain(spark, sf):
    """Documents written in three layouts, each third by a program of its time, read twice
    by the newest: before and after the older ones are rewritten."""
    steps = (lambda df: df.withColumn("tags", F.array().cast("array<string>")), lambda df: df.withColumnRenamed("text", "content").withColumn("chars", F.length("content").cast("long")))
    notes = Migrations("notes", *steps)
    store = Store(spark, fresh_folder(spark, "notes"))
    d = views.table(spark, sf, "documents").filter("doc_id IS NOT NULL").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    third = lambda k: d.filter(F.col("doc_id") % 3 == k)
    Migrations("notes").write(store, third(0).select("doc_id", "text"))
    Migrations("notes", steps[0]).write(store, third(1).select("doc_id", "text", F.array_compact(F.array("lang")).alias("tags")))
    notes.write(store, third(2).select("doc_id", F.col("text").alias("content"), F.array_compact(F.array("lang")).alias("tags"), F.length("text").cast("long").alias("chars")))
    # the same rows through the chain and, once rewritten, without it
    through = notes.read(store.snapshot())
    notes.apply(store)
    both = through.unionByName(notes.read(store.snapshot())).groupBy("doc_id", "chars", F.size("tags").alias("tags")).count().filter("count = 2")
    return both.groupBy((F.col("doc_id") % 3).alias("written_at")).agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.count_if(F.col("tags") > 0).alias("with_lang"))


@query("embedding_sync", "SELECT true AS stopped_early, count(*) AS embedded, count(DISTINCT sha256(coalesce(text, ''))) AS versions FROM documents WHERE doc_id IS NOT NULL")
def embedding_sync(spark, sf):
    """Vectors of all documents in two runs, the first of which has time for one block."""
    m = views.memories(spark, sf).filter("id IS NOT NULL")
    work = EmbeddingSync(Store(spark, fresh_folder(spark, "sync")), HashingEmbedder(16), block=max(1, m.count() // 3))
    first = work.run(m, 0.0)
    work.run(m, float("inf"))
    done = current(work.store.snapshot())
    return done.agg(F.lit(not first["done"]).alias("stopped_early"), F.count("*").alias("embedded"), F.countDistinct("version").alias("versions"))


# ---- contradictions by class -----------------------------------------------------

_CLASSES = f"""
s AS MATERIALIZED (SELECT id, list_sort(list_distinct(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+'))) AS w FROM ({_MEM})),
c AS MATERIALIZED (SELECT min(id) AS rep, count(*) AS texts, w, len(w) AS n, list_has_any(w, [{_NEG}]) AS neg FROM s WHERE len(w) > 0 GROUP BY w),
t AS MATERIALIZED (SELECT rep, n, neg, unnest(w) AS word FROM c),
p AS (SELECT least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b, round(count(*) / (x.n + y.n - count(*)), 6) AS jaccard
  FROM t x JOIN t y ON x.word = y.word AND x.neg AND NOT y.neg GROUP BY x.rep, y.rep, x.n, y.n HAVING count(*) / (x.n + y.n - count(*)) >= 0.5)"""


@query("contradiction_classes", f"WITH {_CLASSES} SELECT a, b, jaccard, x.texts AS a_texts, y.texts AS b_texts FROM p JOIN c x ON x.rep = a JOIN c y ON y.rep = b")
def contradiction_classes(spark, sf):
    """Pairs of classes of texts, with how many texts each class has."""
    pairs, members = engines.contradiction_classes(views.memories(spark, sf))
    texts = members.groupBy("rep").agg(F.count("*").alias("n"))
    of = lambda rep, n: texts.select(F.col("rep").alias(rep), F.col("n").alias(n))
    return pairs.withColumn("jaccard", F.round("jaccard", 6)).join(of("a", "a_texts"), "a").join(of("b", "b_texts"), "b")
