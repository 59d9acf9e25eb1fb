"""More registered queries: maintenance and the older generation's analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph, knowledge, maintenance, stats
from ..sources import views
from ..sources.views import NOW
from .catalog import _MEM, _NOISY, _ROWS, _entities_sql, query

_COUNTS = f"SELECT name, count(*) AS mentions FROM ({_entities_sql(_MEM)}) GROUP BY name"


def _counts(spark, sf):
    return graph.entity_counts(graph.entity_support(views.memories(spark, sf)))


@query("noise_cleanup", f"WITH n AS (SELECT id, regexp_matches(content, '(?i)exec host\\s*=\\s*sandbox') AND len(trim(content)) >= 16 AS noise FROM ({_NOISY})) SELECT count(*) FILTER (noise) AS removed, count(*) FILTER (NOT noise) AS remaining FROM n")
def noise_cleanup(spark, sf):
    return maintenance.cleanup_counts(views.noisy(spark, sf), tx.is_noise(F.col("content")))


@query("cleanup_embeddings", f"SELECT CAST(vec_id AS VARCHAR) AS id FROM embeddings WHERE CAST(vec_id AS VARCHAR) NOT IN (SELECT id FROM ({_NOISY}) WHERE regexp_matches(content, '(?i)exec host\\s*=\\s*sandbox'))")
def cleanup_embeddings(spark, sf):
    v = views.vectors(spark, sf).select(F.col("id").cast("string").alias("id"))
    return maintenance.split_noise(views.noisy(spark, sf), v, tx.is_noise(F.col("content")))["embeddings"]


@query("import_missing", "SELECT count(DISTINCT (role, text)) AS n FROM conversations")
def import_missing(spark, sf):
    c = views.table(spark, sf, "conversations").select("role", "text")
    store = c.filter(F.pmod(F.crc32("text"), F.lit(2)) == 0).distinct()
    return maintenance.import_missing(store, c, ["role", "text"]).agg(F.count("*").alias("n"))


@query("result_rows_filter", f"SELECT id FROM ({_NOISY}) WHERE NOT regexp_matches(content, '(?i)exec host\\s*=\\s*sandbox')")
def result_rows_filter(spark, sf):
    m = views.noisy(spark, sf).withColumn("message", F.when(F.col("id").cast("long") % 2 == 0, F.lit("")))
    return m.filter(~tx.is_noise(tx.first_filled(F.col("message"), F.col("content")))).select("id")


@query("entity_mentions", """
WITH e AS (SELECT DISTINCT p_brand AS name FROM part), t AS (SELECT conv_id || ':' || turn AS id, lower(text || ' ' || 'brand#' || (conv_id % 60)) AS t FROM conversations)
SELECT name, id FROM e JOIN t ON contains(t, lower(name)) WHERE list_contains(regexp_extract_all(t, '[\\p{L}\\p{N}_]+'), regexp_extract(lower(name), '[\\p{L}\\p{N}_]+'))""")
def entity_mentions(spark, sf):
    e = views.table(spark, sf, "part").select(F.col("p_brand").alias("name")).distinct()
    t = views.turns(spark, sf).select(F.col("uuid").alias("id"), F.concat("text", F.lit(" Brand#"), (F.col("conv_id") % 60).cast("string")).alias("content"))
    return maintenance.mentions(e, t)


@query("merge_primary_first", "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS origin FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def merge_primary_first(spark, sf):
    d = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return maintenance.merge_first(d.filter("id % 2 = 0").withColumn("origin", F.lit("first")), d.filter("id % 3 = 0").withColumn("origin", F.lit("second")), key="id")


@query("confidence_meta", "SELECT round(a, 6) AS top, round(b, 6) AS second, round(a - b, 6) AS gap, concat_ws(',', CASE WHEN a < 0.6 THEN 'low_score' END, CASE WHEN a - b < 0.08 THEN 'close_second' END) AS reasons FROM (SELECT max(s) FILTER (r = 1) AS a, max(s) FILTER (r = 2) AS b FROM (SELECT s, row_number() OVER (ORDER BY s DESC) AS r FROM (SELECT list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE v.vec_id <> 0)))")
def confidence_meta(spark, sf):
    from ..operators import recall

    v = views.vectors(spark, sf)
    near = recall.nearest(v.filter("id != 0"), v.filter("id = 0").select(F.col("embedding").alias("q")), 10)
    return maintenance.confidence(near).withColumns({c: F.round(c, 6) for c in ("top", "second", "gap")})


@query("candidate_union", f"""
WITH m AS ({_MEM}), c AS (
 SELECT id, 0 AS k FROM (SELECT id FROM m ORDER BY created_at DESC, id LIMIT 40) UNION ALL
 SELECT id, 1 FROM (SELECT id FROM m ORDER BY importance DESC, created_at, id LIMIT 20) UNION ALL SELECT id, 2 FROM m WHERE contains(lower(content), 'license'))
SELECT id, ['recent', 'tail', 'lexical'][min(k) + 1] AS origin FROM c GROUP BY id""")
def candidate_union(spark, sf):
    return maintenance.candidates(views.memories(spark, sf), ["license"], 40, 20)


@query("journal_replay", "SELECT user_id AS id, arg_max(event_type = 'error', event_id) AS deleted FROM events GROUP BY user_id")
def journal_replay(spark, sf):
    j = views.table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), (F.col("event_type") == "error").alias("deleted"))
    return maintenance.replay(j)


@query("journal_replay_half", "SELECT user_id AS id, arg_max(event_type = 'error', event_id) AS deleted FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) GROUP BY user_id")
def journal_replay_half(spark, sf):
    """The state of each id at the middle of the journal."""
    j = views.table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), (F.col("event_type") == "error").alias("deleted"))
    return maintenance.replay(j, j.agg(F.max("seq")).first()[0] // 2)


@query("journal_changed", "SELECT DISTINCT user_id AS id FROM events WHERE event_id > 900")
def journal_changed(spark, sf):
    j = views.table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"))
    return maintenance.changed_since(j, 900)


@query("priority_lists", "SELECT role, conv_id, turn FROM (SELECT role, conv_id, turn, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS r FROM conversations) WHERE r <= 20")
def priority_lists(spark, sf):
    c = views.table(spark, sf, "conversations").withColumn("at", F.struct("conv_id", "turn"))
    return maintenance.last_each(c, "role", "at", 20).select("role", "conv_id", "turn")


@query("source_ranking", """
WITH f AS (SELECT event_type AS source, 0.85 + 0.3 * (count(*) FILTER (value >= 5) + 1) / (count(*) + 2) AS m FROM events GROUP BY 1)
SELECT event_id AS id, round(score * m, 6)::DOUBLE AS total FROM (SELECT event_id, event_type AS source, (event_id % 100) / 100.0 AS score FROM events) JOIN f USING (source) WHERE score * m >= 0.6 ORDER BY round((score * m)::DOUBLE, 9) DESC, id LIMIT 5""")
def source_ranking(spark, sf):
    e = views.table(spark, sf, "events")
    f = stats.feedback_rank(e.select(F.col("event_type").alias("source"), (F.col("value") >= 5).alias("success")))
    r = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), (F.col("event_id") % 100 / 100.0).alias("score"))
    return maintenance.source_ranking(r, f, 0.6, 5).select("id", F.round("total", 6).alias("total"))


@query("tag_pairs", f"WITH t AS (SELECT DISTINCT id, unnest(tags) AS tag FROM ({_MEM})), n AS (SELECT id AS a, lead(id) OVER (PARTITION BY tag ORDER BY id) AS b FROM t) SELECT DISTINCT a, b FROM n WHERE b IS NOT NULL ORDER BY a, b LIMIT 20")
def tag_pairs(spark, sf):
    return maintenance.tag_pairs(views.memories(spark, sf), 20)


@query("information_gaps", f"SELECT name, mentions, round(1 / (mentions + 1), 6)::DOUBLE AS potential FROM ({_COUNTS}) WHERE mentions < 3 ORDER BY potential DESC, name LIMIT 10")
def information_gaps(spark, sf):
    return maintenance.information_gaps(_counts(spark, sf)).select("name", "mentions", F.round("potential", 6).alias("potential"))


@query("gap_dispatch", f"""
WITH g AS (SELECT name, mentions % 5 AS sources, mentions % 3 AS repeats, mentions % 7 AS links FROM ({_COUNTS})), h AS (SELECT name, mentions % 9 AS tries, {NOW} - mentions * 40000.0 AS last FROM ({_COUNTS}) WHERE mentions % 2 = 0)
SELECT name, round(least(1.0, 0.15 * sources + 0.07 * repeats + 0.08 * links), 6)::DOUBLE AS confidence, CASE WHEN 0.15 * sources + 0.07 * repeats + 0.08 * links >= 0.8 THEN 'resolve' WHEN 0.15 * sources + 0.07 * repeats + 0.08 * links >= 0.5 THEN 'watch' WHEN 0.15 * sources + 0.07 * repeats + 0.08 * links >= 0.12 THEN 'ask' ELSE 'skip' END AS action
FROM g LEFT JOIN h USING (name) WHERE last IS NULL OR {NOW} - last >= 86400 * least(tries, 7)""")
def gap_dispatch(spark, sf):
    c = _counts(spark, sf)
    n = F.col("mentions")
    g = c.select("name", (n % 5).alias("sources"), (n % 3).alias("repeats"), (n % 7).alias("links"))
    h = c.filter(n % 2 == 0).select("name", (n % 9).alias("tries"), (NOW - n * 40000.0).alias("last"))
    return maintenance.gap_dispatch(g, h, NOW)


@query("shortcuts", f"""
WITH c AS ({_COUNTS}), h AS (SELECT name AS hub, row_number() OVER (ORDER BY mentions DESC, name) - 1 AS k FROM c QUALIFY k < 20), n AS (SELECT count(*) AS n FROM h)
SELECT name, hub FROM (SELECT name, ('0x' || substr(md5(name || ':17'), 1, 8))::BIGINT % n AS k FROM c, n WHERE mentions < 3) JOIN h USING (k) WHERE name <> hub""")
def shortcuts(spark, sf):
    return maintenance.hubs_to_edge(_counts(spark, sf), 20, 3, 17)


@query("associate_top", f"WITH r AS (SELECT name, row_number() OVER (ORDER BY mentions DESC, name) AS r FROM ({_COUNTS}) WHERE mentions >= 5 QUALIFY r <= 20) SELECT b.name AS source, a.name AS target FROM r a JOIN r b ON a.r > b.r WHERE b.r <= 10")
def associate_top(spark, sf):
    return maintenance.associate_top(_counts(spark, sf), 5, 20, 10)


@query("novel_links", "WITH l AS (SELECT conv_id, count(*) / 20.0 AS strength FROM conversations GROUP BY conv_id) SELECT conv_id, strength::DOUBLE AS strength, round((0.3 - strength) * 2, 6)::DOUBLE AS potential FROM l WHERE strength < 0.3")
def novel_links(spark, sf):
    c = views.table(spark, sf, "conversations").groupBy("conv_id").agg((F.count("*") / 20.0).alias("strength"))
    return maintenance.novel_links(c).withColumn("potential", F.round("potential", 6))


@query("hebbian_update", "WITH l AS (SELECT conv_id, least(1.0, count(*) / 10.0) AS s FROM conversations GROUP BY conv_id) SELECT conv_id AS a, round(least(1.0, (conv_id % 10) / 100.0 + 0.2 * s), 6)::DOUBLE AS weight FROM l WHERE (conv_id % 10) / 100.0 + 0.2 * s >= 0.1")
def hebbian_update(spark, sf):
    c = views.table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("a")).agg(F.least(F.lit(1.0), F.count("*") / 10).alias("strength"))
    return graph.strengthen(c.withColumn("weight", F.col("a") % 10 / 100.0)).select("a", F.round("weight", 6).alias("weight"))


@query("evolution_old", f"SELECT count(*) AS total, count(*) FILTER (created_at >= {NOW} - 86400) AS last_day, round(100 * count(*) FILTER (doc_id % 4 = 0) / count(*), 4) AS verification_rate, round(100 * count(vec_id) / count(*), 4) AS coverage FROM ({_MEM}) LEFT JOIN (SELECT vec_id FROM embeddings) ON vec_id = doc_id")
def evolution_old(spark, sf):
    v = views.vectors(spark, sf).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("embedding"))
    m = views.memories(spark, sf).join(v, "id", "left").withColumn("verified", F.col("id").cast("long") % 4 == 0)
    return maintenance.evolution_old(m, NOW)


@query("guard_reuse", "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 2 = 1 THEN 'new' WHEN doc_id % 3 = 0 THEN 'tombstoned' WHEN doc_id % 5 = 0 THEN 'different' ELSE 'same' END AS outcome FROM documents")
def guard_reuse(spark, sf):
    m = views.memories(spark, sf)
    n = F.col("id").cast("long")
    version = F.sha2(F.to_json(F.struct("content", "tags", "importance")), 256)
    store = m.filter(n % 2 == 0).select("id", F.when(n % 5 == 0, "old").otherwise(version).alias("version"), (n % 3 == 0).alias("deleted"))
    return maintenance.guard_reuse(store, m.select("id", version.alias("version")))


@query("verified_entities", "WITH l AS (SELECT role AS name, text, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, text) AS r FROM conversations), h AS (SELECT DISTINCT name, unnest(regexp_extract_all(lower(text), 'the|is|and|of')) AS e FROM l WHERE r <= 20) SELECT name, least(count(*), 3) AS n FROM h GROUP BY name")
def verified_entities(spark, sf):
    c = views.table(spark, sf, "conversations").select(F.col("role").alias("name"), F.col("text").alias("content"), F.col("conv_id").alias("created_at"))
    return maintenance.verified_entities(c, "the|is|and|of")


@query("tag_conflicts", f"WITH t AS (SELECT unnest(tags) AS tag, regexp_matches(content, '(?i)thanon|with') AS p, regexp_matches(content, '(?i)license|not') AS n FROM ({_MEM})) SELECT tag, count(*) FILTER (p) AS positive, count(*) FILTER (n) AS negative FROM t GROUP BY tag HAVING count(*) FILTER (p) > 0 AND count(*) FILTER (n) > 0")
def tag_conflicts(spark, sf):
    return maintenance.tag_conflicts(views.memories(spark, sf), ("thanon", "with"), ("license", "not"))


@query("sentiment_conflicts", "WITH m AS (SELECT role AS name, count(*) FILTER (regexp_matches(text, '(?i)with|the')) AS positive, count(*) FILTER (regexp_matches(text, '(?i)not|of')) AS negative FROM conversations GROUP BY role) SELECT name, positive, negative, CASE WHEN positive > negative THEN 'positive' ELSE 'negative' END AS verdict FROM m WHERE positive > 0 AND negative > 0")
def sentiment_conflicts(spark, sf):
    c = views.table(spark, sf, "conversations").select(F.col("role").alias("name"), F.col("text").alias("content"))
    return stats.sentiment_conflicts(c.select("name").distinct(), c, ("with", "the"), ("not", "of"))


@query("energy_score", "SELECT CAST(doc_id AS VARCHAR) AS id, round(greatest(0.3, (doc_id % 11) / 10.0 * 0.9), 2)::DOUBLE AS energy FROM documents")
def energy_score(spark, sf):
    m = views.memories(spark, sf).withColumn("b", F.lit(0.9))
    return m.select("id", stats.energy(["importance", "b"]).alias("energy"))


@query("review_decisions", f"WITH r AS ({_ROWS}) SELECT id, CASE WHEN id % 5 = 0 THEN 'REJECTED' WHEN s[3] > s[1] THEN 'REJECTED' WHEN s[1] >= 0.6 THEN 'VERIFIED_EXTRACT' ELSE 'NEEDS_OWNER_REVIEW' END AS decision FROM r")
def review_decisions(spark, sf):
    r = views.scored_rows(spark, sf).withColumn("extract_ok", F.col("id") % 5 != 0)
    return knowledge.review_decision(r, 0.6).select("id", "decision")


@query("section_budget", f"""
WITH m AS (SELECT id, tags[1] AS section, doc_id AS rank, CASE WHEN len(content) = 0 THEN 0 ELSE greatest(1, len(content) // 4) END AS tokens FROM ({_MEM}) ORDER BY importance DESC, id LIMIT 40),
c AS (SELECT section, CASE section WHEN 'en' THEN 2000 WHEN 'fr' THEN 1200 ELSE 800 END AS budget, list({{'u': tokens::BIGINT, 'id': id}} ORDER BY rank) AS x FROM m WHERE section IN ('en', 'fr', 'de') GROUP BY section)
SELECT section, unnest(list_reduce(list_concat([{{'u': 0::BIGINT, 'k': []::VARCHAR[], 'id': ''}}], list_transform(x, lambda v: {{'u': v.u, 'k': []::VARCHAR[], 'id': v.id}})),
 lambda s, v: CASE WHEN s.u + v.u <= budget THEN {{'u': s.u + v.u, 'k': list_append(s.k, v.id), 'id': ''}} ELSE s END).k) AS id FROM c""")
def section_budget(spark, sf):
    m = views.memories(spark, sf).orderBy(F.desc("importance"), "id").limit(40)
    items = m.select(F.get("tags", F.lit(0)).alias("section"), F.col("id").cast("long").alias("rank"), "id", tx.estimate_tokens(F.col("content")).alias("tokens"))
    return maintenance.sections(items, {"en": 0.5, "fr": 0.3, "de": 0.2}, 4000)
