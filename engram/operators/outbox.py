"""The outbox of projection jobs: pending ones, their replay, what they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(outbox: DataFrame) -> DataFrame:
    """Jobs in order of their time, then id."""
    return outbox.orderBy("updated_at", "id")


def judged(outbox: DataFrame, episodes: DataFrame) -> DataFrame:
    """``outbox`` (id, version, operation, updated_at) with ``outcome``.

    An upsert whose episode is gone (or deleted) or has another version is a
    mismatch; the first one in order ends the replay, so later jobs wait.  Jobs
    before it are done.  ``episodes``: id, version, deleted.
    """
    e = episodes.filter(~F.col("deleted")).select("id", F.col("version").alias("now"))
    j = outbox.join(e, "id", "left")
    bad = (F.col("operation") == "upsert") & ~F.coalesce(F.col("now") == F.col("version"), F.lit(False))
    j = j.withColumn("bad", bad).withColumn("at", F.struct("updated_at", "id"))
    # one row: the first mismatch
    first = j.filter("bad").agg(F.min("at").alias("stop"))
    outcome = F.when(F.col("stop").isNull() | (F.col("at") < F.col("stop")), "done").when(F.col("at") == F.col("stop"), "mismatch").otherwise("waits")
    return j.crossJoin(F.broadcast(first)).withColumn("outcome", outcome).drop("now", "bad", "at", "stop")


def replayed(jobs: DataFrame, projection: DataFrame, fresh: DataFrame) -> DataFrame:
    """A projection after the jobs that are done: rows of their ids go, those of
    upserts come anew from ``fresh`` (the projection of the episodes).  Running it
    again changes nothing."""
    done = jobs.filter("outcome = 'done'")
    kept = projection.join(done.select("id"), "id", "left_anti")
    added = fresh.join(done.filter("operation = 'upsert'").select("id"), "id", "left_semi")
    return kept.unionByName(added)


def left_over(jobs: DataFrame) -> DataFrame:
    """Jobs that stay in the outbox."""
    return jobs.filter("outcome != 'done'").drop("outcome")
