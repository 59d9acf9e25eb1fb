"""Context packets: ranked items under a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens


def prune(semantic: DataFrame, recent: DataFrame, budget: int) -> DataFrame:
    """(section, rank, id, tokens): items kept in order until one overflows.

    Each section stops at its first overflow; the recent one goes on from what
    the semantic one used.  Inputs: rank, id, content (a bounded top-k each).
    """
    def cut(df: DataFrame, name: str) -> DataFrame:
        t = df.select(F.lit(name).alias("section"), "rank", "id", estimate_tokens(F.col("content")).alias("tokens"))
        return t.withColumn("upto", F.sum("tokens").over(W.orderBy("rank").rowsBetween(W.unboundedPreceding, W.currentRow)))

    first = cut(semantic, "semantic").filter(F.col("upto") <= budget)
    used = first.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("used"))
    second = cut(recent, "recent").crossJoin(F.broadcast(used)).filter(F.col("used") + F.col("upto") <= budget)
    return first.drop("upto").unionByName(second.drop("upto", "used"))


def greedy_lines(items: Column, budget: int) -> Column:
    """Places of the items (array of costs) that a skip-and-go-on greedy keeps."""
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))
    pairs = F.transform(items, lambda x, k: F.struct(x.cast("int").alias("cost"), k.alias("at")))
    step = lambda s, x: F.when(s["used"] + x["cost"] <= budget, F.struct((s["used"] + x["cost"]).alias("used"), F.array_append(s["kept"], x["at"]).alias("kept"))).otherwise(s)
    return F.aggregate(pairs, start, step, lambda s: s["kept"])


def keep_first(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """One row of each key, the first in order."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__r = 1").drop("__r")


def synthesis(query: str, semantic: DataFrame, recent: DataFrame) -> DataFrame:
    """One row, ``answer``: the top snippets with their scores, then recent ones
    not among them.  Inputs are top-k frames: rank, score, content."""
    s = semantic.filter("rank <= 3").agg(F.array_sort(F.collect_list(F.struct("rank", F.format_string("- (%.2f) %s", "score", F.trim("content")).alias("t")))).alias("s"))
    r = recent.filter("rank <= 2").agg(F.array_sort(F.collect_list(F.struct("rank", F.trim("content").alias("t")))).alias("r"))
    lines = F.transform("s", lambda x: x["t"])
    more = F.aggregate("r", lines, lambda out, x: F.when(F.exists(out, lambda line: F.contains(line, x["t"])), out).otherwise(F.array_append(out, F.concat(F.lit("- (recent) "), x["t"]))))
    both = s.crossJoin(r).select(more.alias("lines"))
    return both.select(F.when(F.size("lines") == 0, F.lit(f"No relevant memory found for: {query}")).otherwise(F.concat(F.lit(f"Relevant memory for '{query}':\n"), F.array_join("lines", "\n"))).alias("answer"))


def packet(query: str, semantic: DataFrame, recent: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: query, semantic, recent, entities, token_estimate, sources."""
    def gathered(df: DataFrame, name: str, *columns: str) -> DataFrame:
        return df.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    tokens = semantic.select("content").unionByName(recent.select("content")).agg(F.coalesce(F.sum(estimate_tokens(F.col("content"))), F.lit(0)).alias("token_estimate"))
    out = gathered(semantic, "semantic", "rank", "id", "score").crossJoin(gathered(recent, "recent", "rank", "id")).crossJoin(gathered(entities, "entities", "rank", "name")).crossJoin(tokens)
    sources = F.concat_ws(",", *[F.when(F.size(n) > 0, n) for n in ("semantic", "recent", "entities")])
    return out.select(F.lit(query).alias("query"), "semantic", "recent", "entities", "token_estimate", sources.alias("sources"))


# Profiles of the earlier assembler; shares of the token budget by section.
SECTIONS = ("immediate", "system", "recent", "memory", "graph", "tiers", "synthesis")
PROFILES = {
    "reply_fast": {"token_budget": 2800, "sem_limit": 6, "rec_limit": 4, "hours": 6, "min_score": 0.15, "include_graph": False, "include_tiers": False, "alloc": (0.25, 0.12, 0.26, 0.30, 0.04, 0.03, 0.00)},
    "reply_deep": {"token_budget": 4200, "sem_limit": 8, "rec_limit": 5, "hours": 12, "min_score": 0.15, "include_graph": True, "include_tiers": True, "alloc": (0.18, 0.10, 0.22, 0.28, 0.12, 0.10, 0.00)},
    "discovery": {"token_budget": 3600, "sem_limit": 8, "rec_limit": 4, "hours": 24, "min_score": 0.10, "include_graph": True, "include_tiers": True, "alloc": (0.14, 0.12, 0.20, 0.28, 0.16, 0.10, 0.00)},
}
#: Tokens a section has at least.
LEAST_TOKENS = 16
HEADINGS = {"immediate": "CONSULTA ACTUAL", "system": "ESTADO DEL SISTEMA", "recent": "CONTEXTO RECIENTE", "memory": "MEMORIA RELEVANTE", "graph": "RELACIONES (GRAFO)", "tiers": "MEMORIA PERMANENTE", "synthesis": "SINTESIS COGNITIVA"}


def profile(mode: str) -> dict:
    return PROFILES.get(mode, PROFILES["reply_fast"])


def packed_sections(lines: DataFrame, mode: str) -> DataFrame:
    """(section, kept, used, dropped, text) of a mode's packet, one row a section.

    ``lines``: section, rank, line (bounded lists).  Within each section's share a
    line that does not fit is skipped and the next one tried; a line costs its
    tokens and one more; the query's own line always stays.
    """
    p = profile(mode)
    share = F.create_map(*[F.lit(x) for name, part in zip(SECTIONS, p["alloc"]) for x in (name, max(LEAST_TOKENS, int(p["token_budget"] * part)))])
    cost = F.greatest(F.lit(1), estimate_tokens(F.col("line"))) + 1
    g = lines.filter(F.col("section").isin(*SECTIONS)).groupBy("section").agg(F.sort_array(F.collect_list(F.struct("rank", cost.alias("cost"), "line"))).alias("x")).withColumn("budget", share[F.col("section")])
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"))
    fits = lambda s, v: (s["used"] + v["cost"] <= F.col("budget")) | ((F.col("section") == "immediate") & (F.size(s["kept"]) == 0))
    step = lambda s, v: F.when(fits(s, v), F.struct((s["used"] + v["cost"]).alias("used"), F.array_append(s["kept"], v["line"]).alias("kept"))).otherwise(s)
    got = g.withColumn("s", F.aggregate("x", start, step))
    return got.select("section", F.size("s.kept").alias("kept"), F.col("s.used").alias("used"), (F.size("x") - F.size("s.kept")).alias("dropped"), F.array_join("s.kept", "\n").alias("text"))


def prompt_block(sections: DataFrame) -> DataFrame:
    """One row, ``block``: the sections that have text under their headings, in order."""
    order = F.array_position(F.array(*[F.lit(x) for x in SECTIONS]), F.col("section"))
    heading = F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv])[F.col("section")]
    own = sections.filter("text != ''").select(F.struct(order.alias("k"), F.concat(F.lit("── "), heading, F.lit(" ──\n"), "text").alias("t")).alias("x"))
    whole = own.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n").alias("b"))
    return whole.select(F.when(F.col("b") == "", "").otherwise(F.concat(F.lit("<memory>\n"), "b", F.lit("\n</memory>"))).alias("block"))
