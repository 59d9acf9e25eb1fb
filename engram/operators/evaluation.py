"""Evaluation of three-way classifiers, intervals, percentiles, paired runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normal quantile of a 95 % interval, and bins of the calibration error.
Z, BINS = 1.959964, 10


def predicted(scores: Column) -> Column:
    """Place of the largest score; ties go to the first."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def rescaled(scores: Column, temperature: float) -> Column:
    """Softmax of log scores over a temperature."""
    up = F.transform(scores, lambda x: F.exp(F.ln(F.greatest(x, F.lit(1e-15))) / temperature))
    return F.transform(up, lambda x: x / F.aggregate(up, F.lit(0.0), lambda s, y: s + y))


def metrics(rows: DataFrame, temperature: float = 1.0) -> DataFrame:
    """One row: n, accuracy, nll, brier, ece; ``rows`` has label and scores."""
    s = rows.select("label", rescaled(F.col("scores"), temperature).alias("s"))
    s = s.select("label", "s", predicted(F.col("s")).alias("p"), F.array_max("s").alias("conf"))
    hit = (F.col("p") == F.col("label")).cast("double")
    brier = F.aggregate(F.transform("s", lambda x, k: F.pow(x - (k == F.col("label")).cast("double"), F.lit(2))), F.lit(0.0), lambda a, x: a + x)
    bin_ = F.least(F.lit(BINS - 1), F.floor(F.col("conf") * BINS).cast("int"))
    each = s.select(hit.alias("hit"), (-F.ln(F.greatest(F.col("s")[F.col("label")], F.lit(1e-15)))).alias("nll"), brier.alias("brier"), (F.col("conf") - hit).alias("gap"), bin_.alias("bin"))
    by = each.groupBy("bin").agg(F.count("*").alias("n"), F.sum("hit").alias("hit"), F.sum("nll").alias("nll"), F.sum("brier").alias("brier"), F.abs(F.sum("gap")).alias("gap"))
    n = F.sum("n")
    return by.agg(n.alias("n"), (F.sum("hit") / n).alias("accuracy"), (F.sum("nll") / n).alias("nll"), (F.sum("brier") / n).alias("brier"), (F.sum("gap") / n).alias("ece"))


def confusion(rows: DataFrame) -> DataFrame:
    """(label, p0, p1, p2): predictions by true label."""
    p = rows.select("label", predicted(F.col("scores")).alias("p"))
    return p.groupBy("label").agg(*[F.count_if(F.col("p") == k).alias(f"p{k}") for k in range(3)])


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % score interval of a share; hits must not exceed n."""
    p = hits / n
    d = 1 + Z * Z / n
    mid = (p + Z * Z / (2 * n)) / d
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / d
    checked = F.when((hits < 0) | (hits > n) | (n <= 0), F.raise_error(F.lit("hits out of range")).cast("double"))
    return F.coalesce(checked, F.greatest(F.lit(0.0), mid - half)), F.least(F.lit(1.0), mid + half)


def nearest_rank(df: DataFrame, column: str, fraction: float, by: str) -> DataFrame:
    """(by, value): the nearest-rank percentile of each group."""
    return df.groupBy(by).agg(F.expr(f"percentile_disc({fraction}) WITHIN GROUP (ORDER BY {column})").alias("value"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs over the same rows: agreement, who is right, probability gaps.

    Rows that only one has, or whose labels differ, are an error.
    """
    x = a.select("id", F.col("label").alias("la"), F.col("scores").alias("sa"))
    y = b.select("id", F.col("label").alias("lb"), F.col("scores").alias("sb"))
    j = x.join(y, "id", "full_outer")
    bad = F.col("la").isNull() | F.col("lb").isNull() | (F.col("la") != F.col("lb"))
    j = j.withColumn("la", F.when(bad, F.raise_error(F.lit("runs are not aligned")).cast("int")).otherwise(F.col("la")))
    pa, pb = predicted(F.col("sa")), predicted(F.col("sb"))
    ra, rb = pa == F.col("la"), pb == F.col("la")
    gap = F.array_max(F.zip_with("sa", "sb", lambda u, v: F.abs(u - v)))
    return j.agg(
        F.count("*").alias("n"), F.avg((pa == pb).cast("double")).alias("agreement"), F.count_if(ra & rb).alias("both"),
        F.count_if(ra & ~rb).alias("only_first"), F.count_if(~ra & rb).alias("only_second"), F.count_if(~ra & ~rb).alias("neither"),
        F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap"),
    )
