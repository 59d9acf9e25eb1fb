"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import durable, release


def _contracted(e: DataFrame) -> DataFrame:
    """Every node's larger neighbours to its least one, then its smaller ones.

    Each half is written: it is read twice by the next, and a nested plan would
    hold it as often again at every round.
    """
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    large = durable(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "large")
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    out = durable(large.join(down, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct(), "edges")
    release(large)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the least node.

    Each round links every node's larger neighbours to its least neighbour, then
    every node's smaller ones; rounds grow with the logarithm of a component.
    """
    e = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    before = None
    while True:
        last, e = e, _contracted(e)
        release(last)
        now = e.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first()
        if before == now:
            break
        before = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
