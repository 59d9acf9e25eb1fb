"""Line deduplication by site-relative frequency.

A line is boilerplate on a host when the share of the host's pages that hold it
exceeds a ratio.  Lines are counted as (host, line hash), pre-aggregated before
the shuffle.  What a host drops is a set of at most (mean lines a page) / ratio
hashes, so it is joined to the pages as one array a host, and pages are never
taken apart and put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import durable

#: A line in more than this share of a host's pages goes ...
RATIO = 0.2
#: ... if so many pages of the host hold it at least.
LEAST_PAGES = 3


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def lines_of(html: Column) -> Column:
    """Text lines of a page: what stands between tags and line ends, trimmed."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "\n")
    return F.filter(F.transform(F.split(bare, r"<[^>]*>|\n"), lambda x: F.trim(x)), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, n_lines, n_dropped, text.

    ``text`` is the kept lines joined by line ends.  A line counts once a page;
    lines are compared whole, by 64-bit hash.  A null or empty page has no
    lines; pages without a host form one host, ''.  Rows that repeat a page
    count as pages of their own.  Columns beyond the three named are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), F.col(text_col).cast("string").alias("html"))
    hashed = rows.select("host", F.array_distinct(F.transform(lines_of(F.col("html")), lambda x: F.xxhash64(x))).alias("lines"))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    counts = hashed.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("held")).filter(F.col("held") >= least)
    common = counts.join(totals, "host").filter(F.col("held") > ratio * F.col("pages"))
    sets = durable(common.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("drop")), "boilerplate")
    out = rows.join(sets, "host", "left").withColumn("lines", lines_of(F.col("html")))
    none = F.array().cast("array<bigint>")
    kept = F.filter("lines", lambda x: ~F.array_contains(F.col("drop_set"), F.xxhash64(x)))
    out = out.withColumn("drop_set", F.coalesce("drop", none)).withColumn("kept", kept)
    return out.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
