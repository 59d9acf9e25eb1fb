"""Ordered rule classifiers and detectors as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import matches_any

# Feedback classes by words, the first that matches counts.
FEEDBACK = (
    ("bug_fix", ("error", "fallo", "bug", "incorrecto")),
    ("improvement", ("mejorar", "podrías", "deberías")),
    ("positive", ("bien", "perfecto", "excelente")),
    ("rule", ("nunca", "siempre", "recuerda")),
)
# The two earlier sets of classes.
FEEDBACK_FIRST = (
    ("error", ("error", "fallo", "incorrecto", "mal")),
    ("success", ("bien", "perfecto", "excelente", "good")),
    ("improvement", ("mejorar", "podrías", "deberías")),
)
FEEDBACK_SECOND = (
    ("bug", ("error", "fallo", "bug")),
    ("improvement", ("mejorar", "podrías")),
    ("success", ("bien", "perfecto", "excelente")),
    ("rule", ("nunca", "siempre")),
)
# Levels of risk by words, the first that matches counts.
RISKS = (
    ("critical", ("seguridad", "credencial", "password", "token", "api key")),
    ("high", ("memoria", "comportamiento", "personalidad", "alucinar")),
    ("medium", ("script", "función", "código")),
    ("low", ("documentación", "comentario", "docs")),
)
# Kinds of fix by words of the cause (all groups must have one), and how hard they are.
CAUSES = (
    ("config_update", "simple", (("voz", "audio", "tts"),)),
    ("integration_fix", "medium", (("memoria",), ("olvidas", "no recuerdas"))),
    ("new_feature", "complex", (("alucinar",),)),
)
# Openings of a correction.
CORRECTIONS = (
    r"no,\s*(es|es\s+que|es\s+para)", r"te\s+equivocaste", r"no\s+es\s+(correcto|así)", r"actually\s*,", r"wait,\s*(that's|this)", r"wrong",
    r"incorrect", r"mejor\s+(dicho|dice)", r"quería\s+decir", r"me\s+refiero", r"olvidaste\s+que", r"no\s+entendiste", r"eso\s+no\s+es",
)
# Phrases by which a text says that a model wrote it.
SELF_PHRASES = (r"\bas an ai\b", r"\blarge language model\b", r"\bmy training data\b", r"\bknowledge cutoff\b")
#: Rules over a request: (tool, column, pattern, score).
REQUEST_RULES = (
    ("bulk_extraction", "path", r"(?:export|dump|bulk|all)\b", 0.6),
    ("paged", "path", r"[?&]page=\d+", 0.5),
    ("tracked", "path", r"[?&]ref=", 0.4),
)


def _any(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def first_class(text: Column, classes: tuple, otherwise: str) -> Column:
    """The first class one of whose words the lower-cased text holds."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(otherwise)
    for name, words in reversed(classes):
        out = F.when(_any(low, words), name).otherwise(out)
    return out


def feedback_class(text: Column, classes: tuple = FEEDBACK) -> Column:
    return first_class(text, classes, "general")


def risk_level(text: Column) -> Column:
    """Level of risk; critical and high call for approval."""
    return first_class(text, RISKS, "low")


def fix_kind(text: Column) -> Column:
    """struct<fix, complexity> of the first cause that the text names, or null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(None).cast("struct<fix:string,complexity:string>")
    for fix, how, groups in reversed(CAUSES):
        named = reduce(lambda a, b: a & b, [_any(low, words) for words in groups])
        out = F.when(named, F.struct(F.lit(fix).alias("fix"), F.lit(how).alias("complexity"))).otherwise(out)
    return out


def correction(text: Column) -> Column:
    """The text around the first correction (50 before, 100 after), trimmed, or null.

    Patterns are tried in order on the lower-cased text; the piece is of the text
    itself.
    """
    whole = F.coalesce(text, F.lit(""))
    low = F.lower(whole)
    out = F.lit(None).cast("string")
    for p in reversed(CORRECTIONS):
        found = F.regexp_substr(low, F.lit(p))
        start = F.position(found, low)
        piece = whole.substr(F.greatest(F.lit(1), start - 50), F.least(start - 1, F.lit(50)) + F.char_length(found) + 100)
        out = F.when(found.isNotNull(), F.regexp_replace(piece, r"^\s+|\s+$", "")).otherwise(out)
    return out


def self_phrases(text: Column) -> Column:
    """The phrases found, lower-cased, in order of the list."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.regexp_substr(low, F.lit(p)) for p in SELF_PHRASES]))


def request_tools(rules=REQUEST_RULES) -> Column:
    """array<struct<tool, score>> of the rules a request meets."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")).rlike("(?i)" + p), F.struct(F.lit(t).alias("tool"), F.lit(s).alias("score"))) for t, c, p, s in rules]))


def sampled(key: Column, rate: float) -> Column:
    """A decision by the first 64 bits of the key's sha256: the same on every run."""
    high = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return high < F.lit(str(int(rate * 2**64))).cast("decimal(20,0)")


def importance(text: Column, marks: tuple[tuple[str, float], ...], start: float = 0.3) -> Column:
    """Sum of the marks' weights found in a text, at most 1."""
    out = F.lit(start)
    for p, w in marks:
        out = out + F.when(F.coalesce(text, F.lit("")).rlike("(?i)" + p), w).otherwise(0.0)
    return F.least(F.lit(1.0), out)


def permanent_importance(text: Column, critical: tuple[str, ...], people: tuple[str, ...], projects: tuple[str, ...], agents: tuple[str, ...]) -> Column:
    """0 for noise; else 0.4 for a critical pattern, 0.3 for a person, 0.3 a project,
    0.3 for a word of decision and 0.2 for an agent, at most 1."""
    from .guards import is_permanent_noise

    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    some = lambda words, w: F.when(_any(low, words), w).otherwise(0.0) if words else F.lit(0.0)
    marked = F.when(matches_any(t, critical), 0.4).otherwise(0.0) if critical else F.lit(0.0)
    total = marked + some(people, 0.3) + some(("decisión", "acordado", "prioridad"), 0.3) + some(agents, 0.2)
    for p in projects:
        total = total + some((p,), 0.3)
    return F.when(is_permanent_noise(t), 0.0).otherwise(F.least(F.lit(1.0), total))


def marked_tags(text: Column, marks: dict[str, tuple[str, ...]]) -> Column:
    """kind:word for each word of a kind that the text holds, sorted."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_sort(F.array_compact(F.array(*[F.when(low.contains(w), F.lit(f"{kind}:{w}")) for kind, words in marks.items() for w in words])))
