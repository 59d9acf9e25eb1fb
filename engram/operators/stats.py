"""Counts, health, feedback ranking, topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stats(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def evolution(episodic: DataFrame, semantic: DataFrame, size: DataFrame) -> DataFrame:
    """One row: counts, embedding coverage, graph density, proposals; ``size`` is the one
    row (entities, relationships) of the graph."""
    s = stats(episodic=episodic, semantic=semantic).crossJoin(size)
    cover = F.when(F.col("episodic") > 0, F.col("semantic") / F.col("episodic")).otherwise(1.0)
    dense = F.when(F.col("entities") > 0, F.col("relationships") / F.col("entities")).otherwise(0.0)
    proposals = F.concat_ws(
        ";",
        F.when(cover < 0.95, "backfill embeddings"),
        F.when((F.col("entities") >= 5) & (dense < 0.5), "replay: graph is sparse"),
        F.when((F.col("episodic") > 0) & (F.col("entities") == 0), "review entity rules"),
    )
    return s.select("*", F.round(cover, 4).alias("embedding_coverage"), F.round(dense, 4).alias("graph_density"), proposals.alias("proposals"))


def feedback_rank(feedback: DataFrame) -> DataFrame:
    """(source, success, failure, rate, multiplier), best known first.

    The multiplier is 0.85 + 0.30 * (s + 1) / (s + f + 2).
    """
    g = feedback.groupBy("source").agg(F.count_if("success").alias("s"), F.count_if(~F.col("success")).alias("f"))
    return g.select("source", F.col("s").alias("success"), F.col("f").alias("failure"), (F.col("s") / (F.col("s") + F.col("f"))).alias("rate"), (0.85 + 0.30 * (F.col("s") + 1) / (F.col("s") + F.col("f") + 2)).alias("multiplier"))


def topics(docs: DataFrame, least: int, limit: int, text_col: str = "content") -> DataFrame:
    """(topic, n, priority): words over 4 characters held often; priority n / 10."""
    w = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"\s+")).alias("topic")).filter(F.char_length("topic") > 4)
    return w.groupBy("topic").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "topic").limit(limit).withColumn("priority", F.col("n") / 10)


def sentiment_conflicts(entities: DataFrame, messages: DataFrame, positive: tuple[str, ...], negative: tuple[str, ...]) -> DataFrame:
    """(name, positive, negative, verdict) of entities that messages both praise and blame.

    ``messages``: name, content (one row a mention).  Ties are negative.
    """
    has = lambda ws: F.col("content").rlike("(?i)" + "|".join(ws)).cast("int")
    m = messages.join(entities.select("name"), "name").groupBy("name").agg(F.sum(has(positive)).alias("positive"), F.sum(has(negative)).alias("negative"))
    return m.filter("positive > 0 AND negative > 0").withColumn("verdict", F.when(F.col("positive") > F.col("negative"), "positive").otherwise("negative"))


def recurring(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each row with how often its key came before."""
    return df.withColumn("prior", F.count("*").over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)))


def energy(factors: list[str]):
    """Product of health factors, at least 0.3, to 2 places."""
    p = F.lit(1.0)
    for f in factors:
        p = p * F.col(f)
    return F.round(F.greatest(F.lit(0.3), p), 2)


def tiers(memories: DataFrame, now: float, working: int = 50) -> DataFrame:
    """(id, tier): LONG for the important, the often read or the old; of the rest
    the newest ``working`` stay in WORKING."""
    long_ = (F.col("importance") >= 0.95) | (F.col("access_count") > 10) | ((now - F.col("created_at") > 900) & (F.col("importance") >= 0.7))
    first = memories.select("id", "created_at", long_.alias("long"))
    stay = first.filter("NOT long").orderBy(F.desc("created_at"), "id").limit(working).select("id", F.lit(True).alias("stay"))
    return first.join(stay, "id", "left").select("id", F.when(F.col("stay"), "WORKING").otherwise("LONG").alias("tier"))


def context_summary(messages: DataFrame, verified: DataFrame, pending: DataFrame, now: float) -> DataFrame:
    """One row: messages, verified entities, open contradictions, and what each
    speaker said in the last day, as name:count in order."""
    by = speakers(messages, now).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "speaker", F.col("n").cast("string")))), ",").alias("recent"))
    return stats(total=messages, verified=verified, pending=pending).crossJoin(by)


def speakers(messages: DataFrame, now: float, hours: float = 24) -> DataFrame:
    """(speaker, n): messages of the last hours."""
    return messages.filter(F.col("created_at") > now - hours * 3600).groupBy("speaker").agg(F.count("*").alias("n"))


def hook_metrics(calls: DataFrame) -> DataFrame:
    """(event, handlers_run, total_duration_ms, errors) of hook calls; a handler that
    failed isn't counted as run, nor is its time.

    ``calls``: event, duration_ms, error (null when it went well).
    """
    ok = F.col("error").isNull()
    return calls.groupBy("event").agg(F.count_if(ok).alias("handlers_run"), F.coalesce(F.sum(F.when(ok, F.col("duration_ms"))), F.lit(0.0)).alias("total_duration_ms"), F.count_if(~ok).alias("errors"))


def request_stats(requests: DataFrame) -> DataFrame:
    """One row: total, detected, detection_rate of requests with ``detected``."""
    n = F.count("*")
    hit = F.count_if("detected")
    return requests.agg(n.alias("total"), hit.alias("detected"), F.when(n > 0, hit / n).otherwise(0.0).alias("detection_rate"))
