"""Claims, evidence, summaries and their review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evidence_live(claims: DataFrame, live: DataFrame) -> DataFrame:
    """(id, supported): whether all evidence resolves; none is not support."""
    e = claims.select("id", F.explode_outer("evidence").alias("episode"))
    ok = e.join(live.select(F.col("id").alias("episode"), F.lit(True).alias("ok")).distinct(), "episode", "left")
    return ok.groupBy("id").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("supported"))


def resting_on(claims: DataFrame, gone: DataFrame) -> DataFrame:
    """Claims that cite a forgotten episode, each once."""
    e = claims.select("id", F.explode("evidence").alias("episode"))
    return e.join(gone.select(F.col("id").alias("episode")).distinct(), "episode", "left_semi").select("id").distinct()


def after_forgetting(claims: DataFrame, gone: DataFrame) -> DataFrame:
    """Claims with status SUPERSEDED where their evidence was forgotten."""
    hit = resting_on(claims, gone).withColumn("hit", F.lit(True))
    return claims.join(hit, "id", "left").withColumn("status", F.when(F.col("hit"), "SUPERSEDED").otherwise(F.col("status"))).drop("hit")


def proposed_status(claims: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Status a new claim gets: CONFLICTED when an accepted one disagrees."""
    hit = conflicts.select(F.col("a").alias("id")).distinct().withColumn("hit", F.lit(True))
    return claims.join(hit, "id", "left").select("id", F.when(F.col("hit"), "CONFLICTED").otherwise("PROPOSED").alias("status"))


def check_summaries(statements: DataFrame, episodes: DataFrame) -> DataFrame:
    """(summary, n, errors): each cited span must be what its source still says.

    ``statements``: summary, pos, text, episode, start, stop, sha.
    """
    s = statements.join(episodes.select(F.col("id").alias("episode"), F.col("content").alias("source_text")), "episode", "left")
    span = F.expr("substring(source_text, start + 1, stop - start)")
    error = (
        F.when(F.col("source_text").isNull(), "missing evidence")
        .when(F.sha2("source_text", 256) != F.col("sha"), "source changed")
        .when(span != F.col("text"), "not the cited extract")
    )
    each = s.withColumn("error", error).groupBy("summary").agg(F.count("text").alias("n"), F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.concat_ws(":", F.col("pos").cast("string"), "error")))).alias("e"))
    return each.select("summary", "n", F.when(F.col("n") == 0, "empty summary").otherwise(F.array_join("e", ";")).alias("errors"))


def review_decision(rows: DataFrame, accept: float = 0.9) -> DataFrame:
    """``rows`` (extract_ok, scores) with the decision on each statement.

    Scores must be finite, within [0, 1] and sum to 1 within 1e-4.
    """
    s = F.col("scores")
    total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
    sound = F.forall(s, lambda x: ~F.isnan(x) & (x >= 0) & (x <= 1)) & (F.abs(total - 1) <= 1e-4)
    decision = F.when(~F.col("extract_ok"), "REJECTED").when(~sound, "REJECTED").when(s[2] > s[0], "REJECTED").when(s[0] >= accept, "VERIFIED_EXTRACT").otherwise("NEEDS_OWNER_REVIEW")
    return rows.withColumn("decision", decision)


def review_queue(claims: DataFrame, limit: int) -> DataFrame:
    return claims.filter(F.col("status").isin("PROPOSED", "CONFLICTED")).orderBy("id").limit(limit)


def snapshot(columns: list[str]):
    """Hash of a row's state; equal exactly when the named columns are."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def decide(items: DataFrame, decisions: DataFrame, columns: list[str]) -> DataFrame:
    """(id, outcome): a decision holds only for the state that was reviewed."""
    now = items.select("id", snapshot(columns).alias("now"))
    return decisions.join(now, "id", "left").select("id", F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("seen"), "stale").otherwise(F.col("decision")).alias("outcome"))


def keyed(table: DataFrame, ids: list, deleted: str | None = None) -> DataFrame:
    """Rows of these ids; those marked in ``deleted`` are hidden."""
    own = table.filter(F.col("id").isin(ids))
    return own if deleted is None else own.filter(~F.col(deleted))


def approve(procedures: DataFrame, reviews: DataFrame, live: DataFrame) -> DataFrame:
    """(id, outcome) of reviews of procedures, checked in this order.

    'unsigned' without reviewer or reason; 'not proposed' for an unknown procedure
    or one of another status; 'differs' where steps or conditions aren't those
    reviewed; 'no evidence' where some is missing or gone; else 'APPROVED'.
    ``procedures``: id, precondition, steps, postcondition, evidence, status;
    ``reviews``: id, reviewer, reason and the three expected columns.
    """
    sound = evidence_live(procedures.select("id", "evidence"), live)
    state = ["precondition", "steps", "postcondition"]
    p = procedures.select("id", "status", *state).join(sound, "id", "left")
    r = reviews.select("id", "reviewer", "reason", *[F.col(c).alias(f"want_{c}") for c in state]).join(p, "id", "left")
    signed = (F.trim(F.coalesce("reviewer", F.lit(""))) != "") & (F.trim(F.coalesce("reason", F.lit(""))) != "")
    same = F.lit(True)
    for c in state:
        same = same & F.col(c).eqNullSafe(F.col(f"want_{c}"))
    outcome = F.when(~signed, "unsigned").when(~F.coalesce(F.col("status") == "PROPOSED", F.lit(False)), "not proposed").when(~same, "differs").when(~F.coalesce("supported", F.lit(False)), "no evidence").otherwise("APPROVED")
    return r.select("id", outcome.alias("outcome"))


def revoked(items: DataFrame, gone: DataFrame) -> DataFrame:
    """(id, status) of procedures or summaries after forgetting: REVOKED where some
    evidence was forgotten, which nothing takes back."""
    hit = resting_on(items, gone).withColumn("hit", F.lit(True))
    return items.join(hit, "id", "left").select("id", F.when(F.col("hit"), "REVOKED").otherwise(F.col("status")).alias("status"))


def verified_summaries(summaries: DataFrame, errors: DataFrame) -> DataFrame:
    """(id, status): VERIFIED_EXTRACT without errors, REJECTED with, REVOKED stays.

    ``errors``: summary, errors, as ``check_summaries`` gives.
    """
    e = errors.select(F.col("summary").alias("id"), "errors")
    status = F.when(F.col("status") == "REVOKED", "REVOKED").when(F.coalesce("errors", F.lit("empty summary")) == "", "VERIFIED_EXTRACT").otherwise("REJECTED")
    return summaries.join(e, "id", "left").select("id", status.alias("status"))
