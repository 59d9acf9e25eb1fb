"""Store maintenance and the older generation's analytics."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx


def split_noise(messages: DataFrame, embeddings: DataFrame, noise: Column) -> dict[str, DataFrame]:
    """What a cleanup keeps and removes, and the embeddings left after it."""
    gone = messages.filter(noise)
    return {"kept": messages.filter(~noise), "removed": gone, "embeddings": embeddings.join(gone.select("id"), "id", "left_anti")}


def cleanup_counts(messages: DataFrame, noise: Column) -> DataFrame:
    """One row: removed, remaining, by kind of row."""
    return messages.agg(F.count_if(noise).alias("removed"), F.count_if(~noise).alias("remaining"))


def import_missing(store: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``store`` and the incoming rows whose keys it lacks (each once)."""
    new = incoming.dropDuplicates(keys).join(store.select(*keys).distinct(), keys, "left_anti")
    return store.unionByName(new)


def with_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """``df`` with the columns it lacks, at their defaults."""
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


#: Characters of names in one automaton, and of texts that one task searches, about.
NAME_CHARS, TEXT_CHARS = 1 << 22, 1 << 24
_WORD = r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]+"


def _found():
    """Names of one shard in the texts of one block, by one automaton."""
    def run(names: pa.Table, texts: pa.Table) -> pa.Table:
        import ahocorasick
        import regex

        out: tuple[list, list] = [], []
        if len(names) and len(texts):
            words = regex.compile(_WORD)
            tree, held = ahocorasick.Automaton(), {}
            for name, low, word in zip(*(names[c].to_pylist() for c in ("name", "low", "word"))):
                held.setdefault(low, (word, []))[1].append(name)
            for low, value in held.items():
                tree.add_word(low, value)
            tree.make_automaton()
            for id_, text in zip(texts["id"].to_pylist(), texts["t"].to_pylist()):
                met = {id(value): value for _, value in tree.iter(text)}
                own = set(words.findall(text)) if met else ()
                for word, same in met.values():
                    if word in own:
                        out[0].extend(same)
                        out[1].extend([id_] * len(same))
        return pa.table({"name": pa.array(out[0], type=pa.string()), "id": pa.array(out[1], type=texts.schema.field("id").type)})

    return run


def mentions(entities: DataFrame, messages: DataFrame, text_col: str = "content") -> DataFrame:
    """(name, id): messages in which an entity's name stands, its first word as a word.

    Names are dealt to shards and texts to blocks of bounded size; a task builds an
    automaton of one shard's names and runs the texts of one block through it, so
    what it costs grows with the texts, however many names begin alike.
    """
    e = entities.select("name", F.lower("name").alias("low")).distinct().withColumn("word", F.regexp_extract("low", r"(?U)(\w+)", 1)).filter("word != ''")
    m = messages.select("id", F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).filter("t != ''")
    size = lambda df, c: df.agg(F.sum(F.length(c))).first()[0] or 0
    shards, blocks = (max(1, -(-size(df, c) // most)) for df, c, most in ((e, "low", NAME_CHARS), (m, "t", TEXT_CHARS)))
    # texts of one id may be many: they are dealt by both
    dealt = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    e = e.withColumn("shard", dealt(shards, "low")).withColumn("block", every(blocks))
    m = m.withColumn("block", dealt(blocks, "id", "t")).withColumn("shard", every(shards))
    kind = messages.schema["id"].dataType.simpleString()
    return e.groupBy("shard", "block").cogroup(m.groupBy("shard", "block")).applyInArrow(_found(), f"name string, id {kind}").distinct()


def merge_first(primary: DataFrame, *others: DataFrame, key: str) -> DataFrame:
    """Rows of all frames, of equal keys that of the first frame only."""
    ranked = [df.withColumn("__s", F.lit(k)) for k, df in enumerate((primary, *others))]
    every = reduce(lambda a, b: a.unionByName(b), ranked)
    return every.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy("__s"))).filter("__r = 1").drop("__r", "__s")


def confidence(scored: DataFrame, sure: float = 0.6, gap: float = 0.08) -> DataFrame:
    """One row: top, second, gap, and the reasons to ask again."""
    best = scored.select("score").orderBy(F.desc("score")).limit(2).agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))
    top, second = F.coalesce(F.get("s", F.lit(0)), F.lit(0.0)), F.coalesce(F.get("s", F.lit(1)), F.lit(0.0))
    reasons = F.concat_ws(",", F.when(top < sure, "low_score"), F.when(top - second < gap, "close_second"))
    return best.select(top.alias("top"), second.alias("second"), (top - second).alias("gap"), reasons.alias("reasons"))


def candidates(memories: DataFrame, wanted: list[str], recent: int, tail: int) -> DataFrame:
    """(id, origin): newest rows, important older ones, and rows with a query term;
    a row counts under its first origin."""
    new = memories.orderBy(F.desc("created_at"), "id").limit(recent).select("id", F.lit("recent").alias("origin"))
    old = memories.orderBy(F.desc("importance"), "created_at", "id").limit(tail).select("id", F.lit("tail").alias("origin"))
    low = F.lower(F.coalesce("content", F.lit("")))
    said = memories.filter(reduce(lambda a, b: a | b, [low.contains(w) for w in wanted], F.lit(False))).select("id", F.lit("lexical").alias("origin"))
    return merge_first(new, old, said, key="id")


def replay(journal: DataFrame, upto: int | None = None) -> DataFrame:
    """(id, deleted): state of each id after the whole journal, or its changes up to
    number ``upto``."""
    return (journal if upto is None else journal.filter(F.col("seq") <= upto)).groupBy("id").agg(F.max_by("deleted", "seq").alias("deleted"))


def changed_since(journal: DataFrame, checkpoint: int) -> DataFrame:
    """Ids to index again: those changed after a checkpoint."""
    return journal.filter(F.col("seq") > checkpoint).select("id").distinct()


def last_each(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each list."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))).filter(F.col("__r") <= n).drop("__r")


def source_ranking(rows: DataFrame, feedback: DataFrame, least: float, limit: int) -> DataFrame:
    """Rows by score times their source's multiplier, those of ``least`` or more."""
    f = rows.join(feedback.select("source", "multiplier"), "source", "left").withColumn("total", F.col("score") * F.coalesce("multiplier", F.lit(1.0)))
    return f.filter(F.col("total") >= least).orderBy(F.desc(F.round("total", 9)), "id").limit(limit)


def tag_pairs(memories: DataFrame, limit: int) -> DataFrame:
    """(a, b): first pairs of records that share a tag, by id.

    Records under one tag are linked to the next one.  The first ``limit`` pairs
    start at the first records of a tag, so no tag brings more than those.
    """
    t = memories.select("id", F.explode(F.array_distinct("tags")).alias("tag"))
    t = t.withColumn("r", F.row_number().over(W.partitionBy("tag").orderBy("id"))).filter(F.col("r") <= limit + 1)
    nxt = F.lead("id").over(W.partitionBy("tag").orderBy("id"))
    return t.withColumn("b", nxt).filter("b IS NOT NULL").select(F.col("id").alias("a"), "b").distinct().orderBy("a", "b").limit(limit)


def information_gaps(counts: DataFrame, below: int = 3, limit: int = 10) -> DataFrame:
    """Entities mentioned fewer than ``below`` times, by potential 1 / (mentions + 1)."""
    return counts.filter(F.col("mentions") < below).withColumn("potential", 1 / (F.col("mentions") + 1)).orderBy(F.desc("potential"), "name").limit(limit)


def gap_dispatch(gaps: DataFrame, history: DataFrame, now: float) -> DataFrame:
    """(name, confidence, action) of gaps that are due.

    A gap waits 24 h times its number of tries (7 at most); confidence is
    0.15 s + 0.07 r + 0.08 g over sources, repeats and graph links, and decides
    between asking, watching and resolving at 0.12, 0.5 and 0.8.
    """
    h = gaps.join(history, "name", "left").withColumn("tries", F.coalesce("tries", F.lit(0)))
    due = h.filter(F.col("last").isNull() | (now - F.col("last") >= 86400 * F.least("tries", F.lit(7))))
    c = F.least(F.lit(1.0), 0.15 * F.col("sources") + 0.07 * F.col("repeats") + 0.08 * F.col("links"))
    action = F.when(c >= 0.8, "resolve").when(c >= 0.5, "watch").when(c >= 0.12, "ask").otherwise("skip")
    return due.select("name", F.round(c, 6).alias("confidence"), action.alias("action"))


def hubs_to_edge(counts: DataFrame, hubs: int, below: int, seed: int) -> DataFrame:
    """(name, hub): each little mentioned entity with a hub drawn by the md5 of its name."""
    top = counts.orderBy(F.desc("mentions"), "name").limit(hubs).withColumn("k", F.row_number().over(W.orderBy(F.desc("mentions"), "name")) - 1).select("k", F.col("name").alias("hub"))
    n = top.agg(F.count("*").alias("n"))
    few = counts.filter(F.col("mentions") < below).crossJoin(F.broadcast(n)).withColumn("k", F.conv(F.substring(F.md5(F.concat("name", F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long") % F.col("n"))
    return few.join(top, "k").filter("name != hub").select("name", "hub")


def associate_top(counts: DataFrame, least: int, first: int, second: int) -> DataFrame:
    """(source, target): the most mentioned entities with the next most mentioned."""
    top = counts.filter(F.col("mentions") >= least).orderBy(F.desc("mentions"), "name").limit(first)
    r = top.withColumn("r", F.row_number().over(W.orderBy(F.desc("mentions"), "name")))
    a, b = r.alias("a"), r.filter(F.col("r") <= second).alias("b")
    # two bounded tops: first * second rows at most
    return a.join(b, F.col("a.r") > F.col("b.r")).select(F.col("b.name").alias("source"), F.col("a.name").alias("target"))


def novel_links(links: DataFrame, below: float = 0.3) -> DataFrame:
    """Weak associations by potential 2 (below - strength)."""
    return links.filter((F.col("strength") > 0) & (F.col("strength") < below)).withColumn("potential", (below - F.col("strength")) * 2)


def evolution_old(messages: DataFrame, now: float) -> DataFrame:
    """One row: totals, last day, verification rate in per cent, coverage in per cent."""
    n = F.count("*")
    return messages.agg(
        n.alias("total"), F.count_if(F.col("created_at") >= now - 86400).alias("last_day"),
        F.round(100 * F.count_if("verified") / F.greatest(n, F.lit(1)), 4).alias("verification_rate"),
        F.round(100 * F.count("embedding") / F.greatest(n, F.lit(1)), 4).alias("coverage"),
    )


def guard_reuse(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """(id, outcome) of incoming rows: new, same, or the reason they are refused."""
    s = store.select("id", F.col("version").alias("had"), F.col("deleted").alias("dead"))
    out = F.when(F.col("had").isNull(), "new").when(F.col("dead"), "tombstoned").when(F.col("had") == F.col("version"), "same").otherwise("different")
    return incoming.join(s, "id", "left").select("id", out.alias("outcome"))


def verified_entities(mentioned: DataFrame, evidence: str, each: int = 20, most: int = 3) -> DataFrame:
    """(name, n): distinct evidence found in an entity's last mentions.

    ``mentioned``: name, content, created_at.
    """
    last = mentioned.withColumn("r", F.row_number().over(W.partitionBy("name").orderBy(F.desc("created_at"), "content"))).filter(F.col("r") <= each)
    hit = last.select("name", F.explode(F.regexp_extract_all(F.lower("content"), F.lit(evidence), F.lit(0))).alias("e")).distinct()
    return hit.groupBy("name").agg(F.least(F.count("*"), F.lit(most)).alias("n"))


def tag_conflicts(memories: DataFrame, positive: tuple[str, ...], negative: tuple[str, ...]) -> DataFrame:
    """(tag, positive, negative): tags under which both tones occur."""
    has = lambda ws: tx.matches_any(F.coalesce("content", F.lit("")), ws)
    t = memories.select(F.explode("tags").alias("tag"), has(positive).alias("p"), has(negative).alias("n"))
    return t.groupBy("tag").agg(F.count_if("p").alias("positive"), F.count_if("n").alias("negative")).filter("positive > 0 AND negative > 0")


def sections(items: DataFrame, shares: dict[str, float], budget: int) -> DataFrame:
    """(section, id): items kept by a skip-and-go-on greedy within each section's share.

    ``items``: section, rank, id, tokens (bounded lists).
    """
    from ..plans.context import greedy_lines

    share = reduce(lambda out, kv: F.when(F.col("section") == kv[0], F.lit(int(kv[1] * budget))).otherwise(out), shares.items(), F.lit(0))
    g = items.groupBy("section").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "tokens"))).alias("x")).withColumn("b", share)
    out = []
    for name, part in shares.items():
        own = g.filter(F.col("section") == name)
        kept = greedy_lines(F.transform("x", lambda v: v["tokens"]), int(part * budget))
        out.append(own.select("section", F.explode(F.transform(kept, lambda k: F.get("x", k)["id"])).alias("id")))
    return reduce(lambda a, b: a.unionByName(b), out)


def without_reports(lists: dict[str, DataFrame], filtered: bool = True, text_col: str = "content") -> DataFrame:
    """Rows of all lists (each cut to its limit before) under ``list``, without
    automated reports unless ``filtered`` is off."""
    every = reduce(lambda a, b: a.unionByName(b), [df.withColumn("list", F.lit(name)) for name, df in lists.items()])
    return every.filter(~tx.is_report(F.col(text_col))) if filtered else every


def investigated(tasks: DataFrame, memories: DataFrame, words: tuple[str, ...], marker: str, text_col: str = "content") -> DataFrame:
    """(name, done): whether a memory later than a task names its entity ('_' as a
    space), holds one of the words and isn't a task itself.

    ``tasks`` (name, at) are a bounded list, sent to all memories.
    """
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    found = memories.filter(reduce(lambda a, b: a | b, [low.contains(w) for w in words]) & ~F.col(text_col).contains(marker)).select(low.alias("low"), "created_at")
    named = F.regexp_replace(F.col("name"), "_", " ").alias("name")
    t = F.broadcast(tasks.select(named, "at"))
    hit = found.join(t, (F.col("created_at") > F.col("at")) & F.col("low").contains(F.col("name"))).select("name").distinct().withColumn("hit", F.lit(True))
    return tasks.select(named).join(hit, "name", "left").select("name", F.coalesce("hit", F.lit(False)).alias("done"))


def write_state(state: DataFrame, folder: str) -> None:
    """One row as a JSON document; what stood there goes."""
    state.coalesce(1).write.mode("overwrite").json(folder)


def read_state(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(folder)
