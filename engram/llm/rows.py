"""Decisions about rows, by row: ids and whole rows may repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Verdicts of so many rows (16 bytes each where they are held) are sent to all tasks
#: once counted; more are joined by shuffle.
MOST_SENT = 1 << 21


def bounded(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """A written table of a few bytes a row, to be sent to all tasks if its rows are
    counted and few."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def row_hash(*columns: str) -> Column:
    """What tells a row from others: a 64-bit hash of its id and text."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])


def without(docs: DataFrame, row: Column, verdicts: DataFrame) -> DataFrame:
    """``docs`` without the rows that go, columns unchanged.

    ``verdicts``: (row, once), each row hash at most once; rows with ``once``
    unset go, of those with it set one stays.  A row that isn't there stays.
    ``verdicts`` is a written table: while it is small, no document is shuffled.
    """
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__doc"), row.alias("__row"))
    kept = held.join(bounded(verdicts.select(F.col("row").alias("__row"))), "__row", "left_anti").select("__doc")
    once = verdicts.filter("once").select(F.col("row").alias("__row"))
    if not once.isEmpty():
        first = F.row_number().over(W.partitionBy("__row").orderBy(F.xxhash64("__doc")))
        kept = kept.unionByName(held.join(bounded(once), "__row").withColumn("__r", first).filter("__r = 1").select("__doc"))
    return kept.select("__doc.*")
