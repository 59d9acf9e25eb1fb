"""The engine's functions for queries written in SQL.

    register(spark)
    spark.sql("SELECT id, cosine_similarity(embedding, hash_embed('green tea')) FROM memories")
    spark.sql("SELECT m.id, c.* FROM (SELECT id, extract_entities(content) AS e FROM memories) m, LATERAL co_mentions(m.e) c")

Scalar functions are SQL functions, which Catalyst inlines; an embedder is a Pandas
UDF, pairs of mentions a table function.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import text as tx
from .vectors import Embedder, HashingEmbedder

_WORDS = r"(?U)(\w+)"


@udtf(returnType="source string, target string")
class CoMentions:
    """Every two names of one text, in order of appearance."""

    def eval(self, entities: list) -> Iterator[tuple]:
        names = [e["name"] for e in entities or []]
        for k, one in enumerate(names):
            for other in names[k + 1 :]:
                yield one, other


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _length(a: str) -> str:
    return f"sqrt(aggregate({a}, 0D, (s, x) -> s + x * x))"


def _entities() -> str:
    """Hashtags, then mentions, then proper names; a name keeps its first type."""
    marked = "transform(regexp_extract_all(coalesce(t, ''), {}, 1), x -> lower(x))"
    stop = ", ".join(_quoted(x) for x in tx.NOT_NAMES)
    proper = f"filter(regexp_extract_all(coalesce(t, ''), {_quoted('(?U)' + tx.PROPER)}, 1), x -> x NOT IN ({stop}) AND char_length(x) >= 3)"
    kinds = (("topic", marked.format(_quoted(r"(?U)#(\w{2,})"))), ("person", marked.format(_quoted(r"(?U)@(\w{2,})"))), ("concept", proper))
    typed, before = [], []
    for kind, names in kinds:
        new = f"array_except(array_distinct({names}), concat(cast(array() AS ARRAY<STRING>){''.join(', ' + b for b in before)}))"
        typed.append(f"transform({new}, x -> named_struct('name', x, 'type', '{kind}'))")
        before.append(names)
    return f"concat({', '.join(typed)})"


def register(spark: SparkSession, embedder: Embedder | None = None) -> None:
    """cosine_similarity, l2_normalize, extract_entities, word_tokens, estimate_tokens,
    hash_embed and co_mentions, for this session."""
    both = "size(a) = size(b) AND size(a) > 0 AND {0} > 0 AND {1} > 0".format(_length("a"), _length("b"))
    dot = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"
    bodies = {
        "cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": f"CASE WHEN {both} THEN {dot} / ({_length('a')} * {_length('b')}) ELSE 0D END",
        "l2_normalize(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": f"transform(array({_length('a')}), n -> CASE WHEN n > 0 THEN transform(a, x -> x / n) ELSE a END)[0]",
        "extract_entities(t STRING) RETURNS ARRAY<STRUCT<name: STRING, type: STRING>>": _entities(),
        "word_tokens(t STRING) RETURNS ARRAY<STRING>": f"array_distinct(regexp_extract_all(lower(coalesce(t, '')), {_quoted(_WORDS)}, 1))",
        "estimate_tokens(t STRING) RETURNS INT": "CASE WHEN char_length(coalesce(t, '')) = 0 THEN 0 ELSE greatest(1, cast(char_length(t) div 4 AS INT)) END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("hash_embed", (embedder or HashingEmbedder()).function())
    spark.udtf.register("co_mentions", CoMentions)
