"""Embeddings brought up to date in steps, under a time budget.

What is missing or stale is listed once, in order of priority, and cut into blocks;
the list is a table of the store.  Each block's vectors are a commit that also moves
the cursor (the manifest holds a writer's last batch), so a run that ends between two
blocks, or dies within one, goes on where it stopped.  Once a list is done, the next
run makes a new one.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import global_rank
from ..functions.vectors import Embedder
from .commits import Snapshot, Store


def current(now: Snapshot) -> DataFrame | None:
    """(id, version, embedding): the last vector written for each id; none before any."""
    if "vectors" not in now.manifest["tables"]:
        return None
    last = W.partitionBy("id").orderBy(F.desc("turn"), F.desc("block"))
    return now.table("vectors").withColumn("r", F.row_number().over(last)).filter("r = 1").select("id", "version", "embedding")


class EmbeddingSync:
    """``block`` rows are embedded between two looks at the clock."""

    def __init__(self, store: Store, embedder: Embedder, block: int = 10_000, clock: Callable[[], float] = time.monotonic):
        self.store, self.embedder, self.block, self.clock = store, embedder, block, clock

    def _turn(self, now: Snapshot) -> int:
        """The number of the list at work, 0 before the first."""
        return now.manifest["writers"].get("sync-list", [0])[0]

    def _listed(self, records: DataFrame, now: Snapshot) -> DataFrame:
        """Ids whose content has no vector, then those whose content has changed since, the
        most important and newest first, by block."""
        rows = records.select("id", "importance", "created_at", F.sha2(F.coalesce("content", F.lit("")), 256).alias("version"))
        had = current(now)
        if had is not None:
            rows = rows.join(had.select("id", F.col("version").alias("had")), "id", "left").filter("had IS NULL OR had != version")
        else:
            rows = rows.withColumn("had", F.lit(None).cast("string"))
        # what is missing comes first, by importance; then newest, by id
        key = -(F.when(F.col("had").isNull(), 1e6).otherwise(0.0) + F.coalesce("importance", F.lit(0.0)))
        tie = F.struct(F.coalesce(-F.col("created_at"), F.lit(float("inf"))), "id")
        ranked = global_rank(rows.withColumns({"key": key, "tie": tie}), "key", "tie", "place")
        return ranked.select("id", "version", F.floor((F.col("place") - 1) / self.block).cast("int").alias("block"))

    def run(self, records: DataFrame, seconds: float) -> dict:
        """Embed until all is done or the time is up: blocks, done.

        ``records``: id, content, importance, created_at.  At least one block is
        embedded in a run, so that runs of any length come to an end.
        """
        until, made = self.clock() + seconds, 0
        now = self.store.snapshot()
        turn = self._turn(now)
        work = now.table("work") if turn else None
        if work is None or self._left(now, turn, work) is None:
            turn += 1
            self.store.commit({"work": self._listed(records, now)}, "sync-list", turn, replace=("work",))
            now = self.store.snapshot()
            work = now.table("work")
        while True:
            at = self._left(now, turn, work)
            if at is None:
                return {"blocks": made, "done": True}
            if made and self.clock() >= until:
                return {"blocks": made, "done": False}
            own = records.select("id", "content").join(work.filter(F.col("block") == at), "id")
            # a record that changed after it was listed is left to the next list
            own = own.filter(F.sha2(F.coalesce("content", F.lit("")), 256) == F.col("version"))
            vectors = own.select("id", "version", self.embedder.column(F.col("content")).alias("embedding"), F.lit(turn).alias("turn"), F.lit(at).alias("block"))
            self.store.commit({"vectors": vectors}, f"sync-{turn % 2}", turn << 32 | at)
            made += 1
            now = self.store.snapshot()

    def _left(self, now: Snapshot, turn: int, work: DataFrame) -> int | None:
        """The next block of the list, none after the last."""
        done = now.manifest["writers"].get(f"sync-{turn % 2}", [-1])[0]
        at = done + 1 - (turn << 32) if done >> 32 == turn else 0
        last = work.agg(F.max("block")).first()[0]
        return at if last is not None and at <= last else None
