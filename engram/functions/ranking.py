"""A global rank without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The least number of ranges into which the key is cut; each file read gives one.
RANGES = 32


def global_rank(df: DataFrame, key: str, tie: str, name: str, ranges: int | None = None, cuts: list[float] | None = None) -> DataFrame:
    """``df`` with the rank (from 1) by ascending ``key``, then ``tie``.

    Rows are dealt to ranges of the key by quantiles (or given cuts), ranked inside their range,
    and moved up by the counts of the ranges before.  A row's range depends on
    its key alone, so a lost task gives the same ranks again.
    """
    if cuts is None:
        ranges = ranges or max(RANGES, len(df.inputFiles()))
        cuts = sorted(set(df.approxQuantile(key, [k / ranges for k in range(1, ranges)], 0.01)))
    at = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(key))) if cuts else F.lit(0)
    rows = df.withColumn("__range", at.cast("int"))
    # one row a range: the counts before it
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    ahead = rows.groupBy("__range").agg(F.count("*").alias("__n")).withColumn("__ahead", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = F.row_number().over(W.partitionBy("__range").orderBy(key, tie))
    ranked = rows.withColumn("__own", own).join(F.broadcast(ahead), "__range")
    return ranked.withColumn(name, F.col("__own") + F.col("__ahead")).drop("__range", "__own", "__ahead")
