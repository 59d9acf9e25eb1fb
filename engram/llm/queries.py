"""The registered queries of this subpackage and the SQL of those it can express."""

from __future__ import annotations

import json
import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.views import spread
from .best_fit_packing import pack
from .chat_format import digests, format_chats
from .exact_dedup import exact_groups
from .hard_negatives import mine
from .language_id import identify
from .license_scan import scan_licenses
from .line_dedup import LEAST_PAGES, RATIO, drop_boilerplate
from .ngram_jaccard_join import near_components
from .pii_surrogates import replace
from .quality_rules import STOP_WORDS, quality_rules
from .secret_scan import scan
from .source_divergence import LEAST_DOCS, SCALE, SMOOTH, audit
from .source_mixing import mix


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(_docs(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def tokenizer_path() -> str:
    """The public vocabulary that the queries pack by."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"]
    return quality_rules(_docs(spark, sf_dir, "doc_id", "text")).select(*names)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_docs(spark, sf_dir, "doc_id", "text"), tokenizer_path())


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_docs(spark, sf_dir, "doc_id", "text", "source"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_docs(spark, sf_dir, "doc_id", "text"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_docs(spark, sf_dir, "doc_id", "text"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_boilerplate(spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_docs(spark, sf_dir, "doc_id", "text"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's ``spark.engram.pii.key``; without one each run has its own."""
    key = (spark.conf.get("spark.engram.pii.key", None) or secrets.token_hex(32)).encode()
    return replace(_docs(spark, sf_dir, "doc_id", "text"), key)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_docs(spark, sf_dir, "doc_id", "text", "lang"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_docs(spark, sf_dir, "text", "lang", "source"))


#: A conversation whose texts look like the marks of templates.
PLANTED = r"\### Assistant: </turn> ok"


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the table are records of one turn; the conversation beside them is one
    record with all its messages."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = rows.select("conv_id", "turn", F.to_variant_object(F.struct("role", "text")).alias("record"))
    messages = [{"role": role, "content": PLANTED} for role in ("user", "assistant")]
    one = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.parse_json(F.lit(json.dumps({"messages": messages}))).alias("record"))
    return digests(format_chats(turns.unionByName(one), F.col("record"), "turn"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(v.withColumn("label", moved), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_license_scan": op2_license_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_secret_scan": op5_secret_scan,
    "op6_line_dedup": op6_line_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_source_mixing": op9_source_mixing,
    "op10_language_id": op10_language_id,
    "op11_source_divergence": op11_source_divergence,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_hard_negatives": op13_hard_negatives,
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op6_line_dedup": rf"""
WITH a AS (
  SELECT row_number() OVER () AS rid, page_id,
         lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
         list_filter(list_transform(regexp_split_to_array(
           regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', chr(10), 'g'),
           '<[^>]*>|\n'), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS pages FROM a GROUP BY host),
held AS (SELECT host, line, count(*) AS held FROM (SELECT DISTINCT rid, host, unnest(lines) AS line FROM a) GROUP BY host, line),
common AS (SELECT host, list(line) AS gone FROM held JOIN totals USING (host) WHERE held >= {LEAST_PAGES} AND held > {RATIO} * pages GROUP BY host),
kept AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS kept FROM a LEFT JOIN common USING (host))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, array_to_string(kept, chr(10)) AS text
FROM kept""",
    "op1_ngram_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(w)]
    ELSE list_transform(range(1, len(w) - 3), lambda i: hash(w[i:i + 4])) END) AS s FROM w),
classes AS (SELECT min(doc_id) AS c, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
tok AS (SELECT c, len(s) AS n, unnest(s) AS t FROM classes),
pairs AS (
  SELECT a.c AS a, b.c AS b FROM tok a JOIN tok b ON a.t = b.t AND a.c < b.c AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
comp AS (SELECT a AS c, min(b) AS component_id FROM reach GROUP BY a)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, sets.doc_id) AS component_id
FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s LEFT JOIN comp ON comp.c = classes.c""",
    "op11_source_divergence": rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({_LOW}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS ln FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(ln) AS ln_all FROM kept GROUP BY lang),
totals AS (SELECT lang, source, coalesce(sum(n), 0) AS n_all FROM g LEFT JOIN n USING (lang, source) GROUP BY lang, source),
s AS (
  SELECT lang, source, term, coalesce(n.n, 0) AS n,
         (1 + {SCALE}::HUGEINT * (coalesce(n.n, 0) + {SMOOTH}) // (n_all + {SMOOTH} * v))::BIGINT AS p,
         (1 + {SCALE}::HUGEINT * (ln + {SMOOTH}) // (ln_all + {SMOOTH} * v))::BIGINT AS q
  FROM totals JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
parts AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 50""",
    "op12_chat_formatting": rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, r, '{PLANTED}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
n AS (SELECT *, length(regexp_replace(s, '[^\\#]', '', 'g')) + (length(s) - length(replace(s, '</', ''))) // 2 AS more FROM (SELECT *, role || text AS s FROM t))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(s) + more + 13)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 3""",
    "op7_exact_dedup": f"""
WITH t AS (SELECT doc_id, sha256({_LOW}) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h)""",
    "op3_quality_rules": f"""
WITH a AS (
  SELECT doc_id, {_WORDS} AS w, coalesce(text, '') AS s,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
b AS (
  SELECT doc_id, w, s, lines, len(w) AS n_words,
         len(array_to_string(w, '')) AS word_chars,
         len(s) - len(regexp_replace(s, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(s) - len(replace(s, '!', '')) AS n_shouts,
         len(list_filter(w, lambda x: list_contains({STOP_WORDS!r}, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS n_stop,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines
  FROM a),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, n_words - 1)) AS i FROM b WHERE n_words >= 3)),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win),
cov AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM rep, (VALUES (0), (1), (2)) v(d) WHERE c > 1 GROUP BY doc_id),
f AS (
  SELECT b.*, coalesce(n, 0) AS n_repeat_words,
         n_words < 50 OR 100 * coalesce(n, 0) > 50 * n_words AS base_failed
  FROM b LEFT JOIN cov USING (doc_id)),
g AS (
  SELECT *, concat_ws(',',
    CASE WHEN n_words < 50 THEN 'length' END,
    CASE WHEN n_repeat_words / greatest(n_words, 1) > 0.5 THEN 'repeated_words' END,
    CASE WHEN word_chars / greatest(n_words, 1) < 2 OR word_chars / greatest(n_words, 1) > 12 THEN 'word_length' END,
    CASE WHEN n_symbols / greatest(n_words, 1) > 0.2 THEN 'symbols' END,
    CASE WHEN n_shouts / greatest(n_words, 1) > 0.2 THEN 'exclamations' END,
    CASE WHEN n_stop / greatest(n_words, 1) < 0.01 THEN 'stop_words' END,
    CASE WHEN n_dup_lines / greatest(n_lines, 1) > 0.4 THEN 'repeated_lines' END) AS failed
  FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND failed = '' AS kept, failed
FROM g""",
}
