"""Quality rules: a threshold table compiled into one projection.

Every metric is a built-in expression over the row's own text; no user
function runs and nothing is shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"

# Frequent function words of the languages served.
STOP_WORDS = "the of and to in is a that it for on with as by this be are was from at le la les de des du et en un une que qui pour est dans par sur au avec el los las y del se por con para su al lo der die das und den von zu mit sich auf ist nicht ein eine dem im auch".split()


class Rule(NamedTuple):
    """A document passes when low <= metric <= high."""

    name: str
    metric: str
    low: float | None
    high: float | None


#: The threshold table.  Metrics are SQL over the columns that ``measure`` adds.
RULES = (
    Rule("length", "n_words", 50, None),
    Rule("repeated_words", "n_repeat_words / n_words", None, 0.5),
    Rule("word_length", "word_chars / n_words", 2.0, 12.0),
    Rule("symbols", "n_symbols / n_words", None, 0.2),
    Rule("exclamations", "n_shouts / n_words", None, 0.2),
    Rule("stop_words", "n_stop_words / n_words", 0.01, None),
    Rule("repeated_lines", "n_dup_lines / n_lines", None, 0.4),
)

#: The columns that ``quality_rules`` adds.
MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed", "kept")


def measure(text: Column) -> dict[str, Column]:
    """Arrays of a text in two steps; see ``quality_rules``."""
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return {"words": words, "lines": lines}


def quality_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept and ``failed`` (names of the broken rules) added.

    A null or empty text has zero everywhere and is not kept.  Columns of the
    input with one of these names are replaced; all others stay, whatever their
    names.  Rows may repeat.  A window of three words is known by a 64-bit hash of
    the three; texts of any length are read whole.
    """
    names = docs.columns
    docs = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    text = F.col("__text")
    stop = "(?i)(?:^|[" + SPACE + "])(?:" + "|".join(STOP_WORDS) + ")(?=[" + SPACE + "]|$)"
    parts = measure(text)
    a = docs.withColumns({
        "__words": parts["words"],
        "__lines": parts["lines"],
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_shouts": F.regexp_count(text, F.lit("!")).cast("long"),
        "n_stop_words": F.regexp_count(text, F.lit(stop)).cast("long"),
        "word_chars": (F.char_length(text) - F.regexp_count(text, F.lit(f"[{SPACE}]"))).cast("long"),
    })
    a = a.withColumns({
        "n_words": F.size("__words").cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        # windows as (hash, place); the last two words begin none
        "__windows": F.expr("transform(slice(__words, 1, greatest(size(__words) - 2, 0)), (w, i) -> struct(xxhash64(w, get(__words, i + 1), get(__words, i + 2)) AS h, i AS i))"),
    }).drop("__words", "__lines")
    a = a.withColumn("__sorted", F.sort_array("__windows")).drop("__windows")
    again = "get(__sorted, k - 1).h <=> x.h OR get(__sorted, k + 1).h <=> x.h"
    a = a.withColumn("__at", F.sort_array(F.expr(f"transform(filter(__sorted, (x, k) -> {again}), x -> x.i)"))).drop("__sorted")
    # words under any of the places: three for each, less what the next one shares
    a = a.withColumn("n_repeat_words", F.expr("cast(aggregate(__at, named_struct('c', 0, 'e', -1), (s, p) -> named_struct('c', s.c + (p + 3 - greatest(p, s.e)), 'e', p + 3), s -> s.c) AS long)")).drop("__at")
    a = a.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    broken = []
    for r in rules:
        value = F.expr(r.metric.replace(" / n_words", " / greatest(n_words, 1)").replace(" / n_lines", " / greatest(n_lines, 1)"))
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (value < r.low)
        if r.high is not None:
            bad = bad | (value > r.high)
        broken.append(F.when(bad, F.lit(r.name)))
    a = a.withColumn("failed", F.concat_ws(",", *broken))
    a = a.withColumn("kept", ~F.col("base_failed") & (F.col("failed") == ""))
    own = [c for c in names if c not in MEASURED]
    return a.select(*[F.col("__doc")[c].alias(c) for c in own], *MEASURED)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that pass, with their own columns only."""
    names = docs.columns
    inner = docs.select(F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    # a filter would be pushed into the projection and copy its expressions many
    # times over; a generator's output isn't
    judged = quality_rules(inner).select(F.explode_outer(F.when(F.col("kept"), F.array("__row"))).alias("__row"))
    return judged.filter(F.col("__row").isNotNull()).select("__row.*")
