"""Session logs: heads and tails, tombstones, threads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import durable, release

# Types of entries that only show progress.
EPHEMERAL = ("progress", "status", "heartbeat", "typing")


def head(entries: DataFrame, n: int, by: str = "conv_id", order: str = "turn") -> DataFrame:
    return entries.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(order))).filter(F.col("__r") <= n).drop("__r")


def tail(entries: DataFrame, n: int, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n entries of each session."""
    return entries.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))).filter(F.col("__r") <= n).drop("__r")


def drop_tombstones(entries: DataFrame, markers: DataFrame, legacy: bool = False) -> DataFrame:
    """Entries without the deleted ones; ``legacy`` drops only the markers."""
    return entries if legacy else entries.join(markers.select("uuid").distinct(), "uuid", "left_anti")


def drop_ephemeral(entries: DataFrame, kind: str = "type") -> DataFrame:
    return entries.filter(~F.coalesce(F.col(kind).isin(*EPHEMERAL), F.lit(False)))


def threads(entries: DataFrame, most: int | None = None) -> DataFrame:
    """(uuid, root, depth): each entry's first ancestor, by pointer doubling.

    A parent that isn't there ends a thread.  Rounds go on until every chain has
    reached its root, so their number is the log2 of the longest; each is written
    as a table.  An entry on a cycle, or leading into one, has no root: its root
    and depth are null.  So has one deeper than ``most``, if that is given.  Each
    uuid stands once.
    """
    ids = entries.select("uuid", "parent")
    known = ids.join(ids.select(F.col("uuid").alias("parent")), "parent", "left_semi")
    p = ids.select("uuid").join(known.select("uuid", "parent"), "uuid", "left").select("uuid", F.coalesce("parent", "uuid").alias("up"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("parent").isNull().alias("done"))
    p, last, rounds = durable(p, "threads"), None, 0
    # where a chain is still open, each round closes some entry of it; cycles stay open
    while (open_ := p.filter("NOT done").count()) and open_ != last and (most is None or 2**rounds <= most):
        q = p.select(F.col("uuid").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("done").alias("done2"))
        moved = p.filter("NOT done").join(q, "up").select("uuid", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), F.col("done2").alias("done"))
        new = durable(p.filter("done").unionByName(moved), "threads")
        release(p)
        p, last, rounds = new, open_, rounds + 1
    end = F.col("done") if most is None else F.col("done") & (F.col("depth") <= most)
    return p.select("uuid", F.when(end, F.col("up")).alias("root"), F.when(end, F.col("depth")).cast("int").alias("depth"))


def leaves(entries: DataFrame) -> DataFrame:
    """Entries that no other names as parent."""
    return entries.join(entries.select(F.col("parent").alias("uuid")).filter("uuid IS NOT NULL").distinct(), "uuid", "left_anti")


def compaction(entries: DataFrame, deleted: str, by: str = "conv_id", above: float = 0.2) -> DataFrame:
    """(by, ratio, compact): share of tombstones, and whether it calls for compaction."""
    return entries.groupBy(by).agg(F.avg(F.col(deleted).cast("double")).alias("ratio")).withColumn("compact", F.col("ratio") > above)
