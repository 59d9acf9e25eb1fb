"""Streaming ingestion: each batch becomes episodes, vectors, tags, terms and graph support.

All projections of a batch are one commit (see ``commits``): a reader sees all of
them or none, and a batch that is replayed after a failure is there once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import injection_level, is_noise
from ..functions.vectors import Embedder
from ..operators.graph import comentions, entity_support
from ..operators.lexical import terms
from ..sources.session_logs import messages
from .commits import Store


def gate(rows: DataFrame) -> DataFrame:
    """Rows that are neither operational noise nor a critical injection."""
    c = F.col("content")
    return rows.filter(~is_noise(c) & (injection_level(c) < 4))


def projections(rows: DataFrame, embedder: Embedder) -> dict[str, DataFrame]:
    """The tables that episodes (id, content, and tags where there are) become."""
    tags = F.col("tags") if "tags" in rows.columns else F.array().cast("array<string>")
    words = rows.select("id", F.explode(terms(F.col("content"))).alias("term"))
    return {
        "episodes": rows,
        "vectors": rows.select("id", embedder.column(F.col("content")).alias("embedding")),
        "tags": rows.select("id", F.explode(F.array_distinct(tags)).alias("tag")),
        "terms": words.groupBy("id", "term").agg(F.count("*").alias("n")),
        "entity_support": entity_support(rows),
        "edge_support": comentions(rows),
    }


def project(batch: DataFrame, batch_id: int, root: str, embedder: Embedder, writer: str = "ingest") -> int:
    """Commit the projections of one batch; the version that holds them."""
    rows = batch.dropDuplicates(["id"]).persist()
    try:
        return Store(batch.sparkSession, root).commit(projections(rows, embedder), writer, batch_id)
    finally:
        rows.unpersist()


def ingest(lines: DataFrame, root: str, checkpoint: str, embedder: Embedder, writer: str = "ingest", **trigger) -> StreamingQuery:
    """Start the stream; ``availableNow=True`` handles what is there and ends."""
    rows = gate(messages(lines))
    return rows.writeStream.foreachBatch(lambda df, k: project(df, k, root, embedder, writer)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def pending(spark: SparkSession, root: str) -> DataFrame:
    """Episodes of the newest version that lack a vector: none, as they come together."""
    now = Store(spark, root).snapshot()
    return now.table("episodes").select("id").distinct().join(now.table("vectors").select("id"), "id", "left_anti")
