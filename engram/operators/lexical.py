"""Lexical retrieval: inverted index, BM25, TF-IDF, rank fusion, hybrid score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import jaccard
from ..storage import durable

# k1 and b of the ranking, and the constant of rank fusion.
K1, B, FUSION = 1.2, 0.75, 60
_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def folded(text: Column) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), *_ACCENTS)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def inverted_index(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """(id, term, tf, dl): one row per term of a document."""
    t = docs.select("id", terms(F.col(text_col)).alias("t")).withColumn("dl", F.size("t"))
    return t.select("id", "dl", F.explode("t").alias("term")).groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, query: str, limit: int, live: DataFrame | None = None, text_col: str = "content") -> DataFrame:
    """(id, bm25, score): the top documents holding any query term.

    N and the mean length are over the whole corpus; a term's idf is
    ln((N - n + 0.5) / (n + 0.5)), 1e-6 where that isn't positive.  For a corpus
    without an index (``StoredIndex``): it is read and split into terms once, and
    only rows with a term of the query, with these terms, are kept.
    ``score`` is 1.0 for every match, as ranks decide; ``live`` filters before
    the cut.
    """
    spark = docs.sparkSession
    asked = spark.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(terms(F.col("q")))).alias("term"))
    wanted = [r["term"] for r in asked.collect()]
    t = docs.select("id", terms(F.col(text_col)).alias("t"))
    own = F.array(*[F.size(F.filter("t", _equals(w))).cast("double") for w in wanted]).cast("array<double>")
    counts = durable(t.select("id", F.size("t").cast("double").alias("dl"), own.alias("c")), "counts")
    total = counts.agg(F.count("*").cast("double").alias("n_all"), F.avg("dl").alias("mean"), F.array(*[F.count_if(F.col("c")[k] > 0).cast("double") for k in range(len(wanted))]).cast("array<double>").alias("held"))
    rows = counts.filter(F.exists("c", lambda x: x > 0)).crossJoin(F.broadcast(total))
    rank = F.lit(0.0)
    for k in range(len(wanted)):
        n, c = F.col("held")[k], F.col("c")[k]
        idf = F.ln((F.col("n_all") - n + 0.5) / (n + 0.5))
        idf = F.when(idf > 0, idf).otherwise(1e-6)
        rank = rank + idf * c * (K1 + 1) / (c + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    out = rows.select("id", rank.alias("bm25"))
    if live is not None:
        out = out.join(live.select("id"), "id", "left_semi")
    return out.orderBy(F.desc(F.round("bm25", 9)), "id").limit(limit).withColumn("score", F.lit(1.0))


def _equals(word: str):
    return lambda x: x == word


def fuse(streams: list[DataFrame], limit: int) -> DataFrame:
    """(id, score): reciprocal-rank fusion of frames with id and rank."""
    one = streams[0].select("id", "rank")
    for s in streams[1:]:
        one = one.unionByName(s.select("id", "rank"))
    return one.groupBy("id").agg(F.sum(1.0 / (FUSION + F.col("rank"))).alias("score")).orderBy(F.desc(F.round("score", 12)), "id").limit(limit)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` (already cut to a few rows) with its rank."""
    return df.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def lexical_score(text: Column, query: str, wanted: list[str]) -> Column:
    """0.20 for the phrase, 0.30 by share of terms, 0.02 a term up to 0.08; at most 0.45."""
    low = F.lower(F.coalesce(text, F.lit("")))
    q = query.strip().lower()
    phrase = F.when(low.contains(q), 0.20).otherwise(0.0) if len(q) >= 4 else F.lit(0.0)
    if not wanted:
        return F.least(phrase, F.lit(0.45))
    hits = sum((low.contains(t).cast("int") for t in wanted), F.lit(0))
    return F.when(low == "", 0.0).otherwise(F.least(phrase + hits / len(wanted) * 0.30 + F.least(hits * 0.02, F.lit(0.08)), F.lit(0.45)))


def recency_bonus(created_at: Column, now: float) -> Column:
    age = F.greatest(F.lit(0.0), (now - created_at) / 86400)
    return F.when(age <= 3, 0.03).when(age <= 14, 0.015).otherwise(0.0)


def short_penalty(text: Column, wanted: list[str]) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    known = sum((F.lower(t).contains(x).cast("int") for x in wanted), F.lit(0)) > 0
    return F.when((t == "") | known, 0.0).when(F.char_length(t) < 18, 0.12).when(F.char_length(t) < 36, 0.07).otherwise(0.0)


def _begin(text: Column, chars: int | None) -> Column:
    t = F.coalesce(text, F.lit(""))
    return t if chars is None else F.substring(t, 1, chars)


def vocabulary(docs: DataFrame, newest: int | None = None, chars: int | None = None, size: int = 384, text_col: str = "content") -> DataFrame:
    """(term, df, idf): the most frequent terms of the documents.

    ``newest`` and ``chars`` confine it to the newest documents and to how they begin.
    Document frequency is at least 2 and at most 0.8 of the documents; idf is
    ln((N + 1) / (df + 1)) + 1.
    """
    some = docs if newest is None else docs.orderBy(F.desc("created_at"), "id").limit(newest)
    some = some.select("id", _begin(F.col(text_col), chars).alias("t"))
    n = some.agg(F.count("*").alias("n"))
    # an inner explode would ask for a filled array first, and look for all words twice
    each = some.select(F.explode_outer(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))).alias("term"))
    df = each.filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
    kept = df.crossJoin(F.broadcast(n)).filter("df >= 2 AND df <= 0.8 * n")
    return kept.orderBy(F.desc("df"), "term").limit(size).select("term", "df", (F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def tfidf(docs: DataFrame, vocab: DataFrame, chars: int | None = None, text_col: str = "content") -> DataFrame:
    """(id, term, weight): (1 + ln count) * idf, of unit length a document."""
    t = docs.select("id", F.explode_outer(F.regexp_extract_all(F.lower(_begin(F.col(text_col), chars)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))).alias("term"))
    # the vocabulary is small by its size, and goes to all tasks: only its terms are counted and moved
    raw = t.join(F.broadcast(vocab), "term").groupBy("id", "term").agg(F.count("*").alias("c"), F.first("idf").alias("idf")).withColumn("w", (1 + F.ln("c")) * F.col("idf"))
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))
    return raw.select("id", "term", (F.col("w") / size).alias("weight"))


def word_overlap(messages: DataFrame, query: str, newest: int = 100, above: float = 0.1, limit: int = 10, text_col: str = "content") -> DataFrame:
    """(id, similarity) of the newest messages by shared words: the first generation's
    search.  Words stand between white space; the similarity is shared / all words."""
    last = messages.orderBy(F.desc("created_at"), "id").limit(newest)
    own = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"), lambda w: w != ""))
    asked = F.array(*[F.lit(w) for w in dict.fromkeys(query.lower().split())]).cast("array<string>")
    scored = last.select("id", jaccard(own, asked).alias("similarity")).filter(F.col("similarity") > above)
    return scored.orderBy(F.desc("similarity"), "id").limit(limit)


def past_mistakes(mistakes: DataFrame, asked: DataFrame, newest: int = 20, limit: int = 5) -> DataFrame:
    """(question, mistake, rank): of the newest mistakes the first few, in order, that
    share a word with a question.

    ``mistakes``: id, at, content; ``asked``: question, content.  The mistakes are a
    bounded list, which is sent to all questions.
    """
    own = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    last = mistakes.orderBy(F.desc("at"), F.desc("id")).limit(newest)
    held = last.agg(F.array_sort(F.collect_list(F.struct("at", "id", own(F.col("content")).alias("w")))).alias("m"))
    words = own(F.col("content"))
    met = F.slice(F.filter("m", lambda x: F.arrays_overlap(x["w"], F.col("w"))), 1, limit)
    found = asked.select("question", words.alias("w")).crossJoin(F.broadcast(held)).select("question", F.posexplode(met).alias("k", "x"))
    return found.select("question", F.col("x.id").alias("mistake"), (F.col("k") + 1).alias("rank"))


def concatenated(query: str, working: DataFrame, stored: DataFrame, linked: DataFrame) -> DataFrame:
    """(tier, id): what each tier finds, one after the other, repeats kept.

    Working and stored rows hold the query; linked ones have one of its words over
    two letters as a tag, once for each.
    """
    low = query.lower()
    held = lambda df, tier: df.filter(F.lower("content").contains(low)).select(F.lit(tier).alias("tier"), "id")
    words = F.array(*[F.lit(w) for w in low.split() if len(w) > 2]).cast("array<string>")
    tagged = linked.select("id", F.explode(words).alias("word"), "tags").filter(F.array_contains(F.transform("tags", lambda t: F.lower(t)), F.col("word")))
    return held(working, "working").unionByName(held(stored, "stored")).unionByName(tagged.select(F.lit("graph").alias("tier"), "id"))


class StoredIndex:
    """A written inverted index: postings by bucket of term, and the corpus's totals.

    A query reads its terms' buckets only, and of them the row groups that hold its
    terms.  ``build`` replaces what is there.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def build(self, docs: DataFrame, text_col: str = "content") -> StoredIndex:
        # a text's terms are counted within its row: its sorted terms, by where each begins
        t = docs.select("id", F.sort_array(terms(F.col(text_col))).alias("t"))
        starts = F.expr("filter(sequence(0, size(t) - 1), i -> i = 0 OR t[i] != t[i - 1])")
        counted = t.select("id", F.size("t").cast("double").alias("dl"), "t", F.when(F.size("t") > 0, starts).alias("at"))
        each = counted.select("id", "dl", F.explode_outer(F.expr("transform(at, (i, k) -> struct(t[i] AS term, CAST(coalesce(get(at, k + 1), size(t)) - i AS DOUBLE) AS tf))")).alias("p"))
        posted = each.filter("p IS NOT NULL").select("id", "dl", "p.term", "p.tf").withColumn("bucket", self._bucket(F.col("term")))
        # frequent buckets are split by id, so that no task writes a term alone
        posted.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/postings")
        # the lengths add up to the counts of all terms, so the texts aren't split again
        held = self.spark.read.schema("tf double").parquet(f"{self.root}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0.0)).alias("held"))
        total = docs.agg(F.count("*").cast("double").alias("n_all")).crossJoin(F.broadcast(held))
        total.select("n_all", F.try_divide("held", "n_all").alias("mean")).write.mode("overwrite").parquet(f"{self.root}/totals")
        return self

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.crc32(term), F.lit(self.BUCKETS)).cast("int")

    def search(self, query: str, limit: int, live: DataFrame | None = None) -> DataFrame:
        """As ``bm25``."""
        asked = self.spark.createDataFrame([(query,)], "q string").select(F.explode(F.array_distinct(terms(F.col("q")))).alias("term"))
        wanted = asked.select("term", self._bucket(F.col("term")).alias("bucket")).collect()
        posted = self.spark.read.parquet(f"{self.root}/postings").filter(F.col("bucket").isin([r["bucket"] for r in wanted]) & F.col("term").isin([r["term"] for r in wanted]))
        held = posted.groupBy("term").agg(F.count("*").cast("double").alias("n"))
        rows = posted.join(F.broadcast(held), "term").crossJoin(F.broadcast(self.spark.read.parquet(f"{self.root}/totals")))
        idf = F.ln((F.col("n_all") - F.col("n") + 0.5) / (F.col("n") + 0.5))
        part = F.when(idf > 0, idf).otherwise(1e-6) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
        out = rows.groupBy("id").agg(F.sum(part).alias("bm25"))
        if live is not None:
            out = out.join(live.select("id"), "id", "left_semi")
        return out.orderBy(F.desc(F.round("bm25", 9)), "id").limit(limit).withColumn("score", F.lit(1.0))
