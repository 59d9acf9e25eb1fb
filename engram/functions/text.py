"""Text predicates and extractors as Column functions; none leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of operational noise, and of automated reports.
NOISE = (
    r"exec host\s*=\s*sandbox",
    r"sandbox runtime\s+(?:is\s+)?unavailable",
    r"exec host not allowed",
    r'"tool"\s*:\s*"exec"',
    r"\bsandbox(?:\s+exec)?\s+(?:no disponible|deshabilitad[oa])\b",
)
REPORTS = (
    r"\bHEARTBEAT_OK\b",
    r"Scout\s+completado\s*-\s*Ciclo\s+\d+",
    r"\[AGENT:[A-Z]+\].*Ciclo\s+\d+",
    r"Ciclo\s+\d+\s*\(\d{2}:\d{2}\s*UTC\)",
)
# The wider lists of the older generation.
NOISE_OLD = (
    r"exec host\s*=\s*sandbox",
    r"sandbox runtime\s+(?:is\s+)?unavailable",
    r"exec host not allowed",
    r"tools\.exec\.host",
    r"agents\.defaults\.sandbox\.mode",
    r"configure tools\.exec\.host",
    r'"tool"\s*:\s*"exec"',
    r"\bexec(?:\s+est[aá])?\s+deshabilitad[oa]\b",
    r"\bejecutor(?:\s+de\s+comandos)?(?:\s+est[aá])?\s+deshabilitad[oa]\b",
    r"\bsandbox(?:\s+exec)?\s+(?:no disponible|deshabilitad[oa]|bloquead[oa])\b",
    r"\bsandbox\s+runtime\s+no\s+est[aá]\s+disponible\b",
    r"\bsandbox\s+exec\b[^\n]{0,40}\bno\s+disponible\b",
)
NOISE_OLD_SOFT = (r"\bhabilitar\s+el\s+sandbox\b", r"\bno puedo(?:\s+\w+){0,8}\s+(?:ejecutar|usar)\s+comandos\b")

# Injection patterns with their level, levels from low to high.
LEVELS = ("none", "low", "medium", "high", "critical")
INJECTION = (
    (r"\bignore\s+(all\s+)?(previous|prior|earlier)\s+instructions?", "critical"),
    (r"\bdisregard\s+(your\s+)?(system\s+)?prompt", "critical"),
    (r"\bforget\s+(what\s+)?(you\s+)?(told|said|know)", "high"),
    (r"\bnew\s+system\s+prompt\s*:", "critical"),
    (r"^\s*system\s*:\s*.", "critical"),
    (r"\breveal\s+(your\s+)?(system\s+)?prompt", "high"),
    (r"\bwhat\s+are\s+your\s+(system\s+)?instructions", "high"),
    (r"\byou\s+don[\s']?t\s+need\s+to\s+(follow|respect|keep)", "high"),
    (r"\bDAN\s+mode", "critical"),
    (r"\bdo\s+anything\s+now", "critical"),
    (r'\{[^}]*"role"[^}]*"system"[^}]*\}', "critical"),
    (r"```system[^`]*```", "critical"),
)
# Words of formal and of casual tone.
FORMAL = ("please", "could you", "would you", "kindly", "appreciate")
CASUAL = ("hey", "sup", "lol", "btw", "ngl", "fr")
# Capitalised spans, one word or more; a boundary of words is dear, so it is
# looked for at capitals only.
PROPER = r"(?=[A-ZÁÉÍÓÚÑ])\b([A-ZÁÉÍÓÚÑ][\wÁÉÍÓÚÑáéíóúñ]+(?:\s+[A-ZÁÉÍÓÚÑ][\wÁÉÍÓÚÑáéíóúñ]+)*)\b"
# Capitalised words that aren't names, and words of negation.
NOT_NAMES = ("El", "La", "Los", "Las", "Un", "Una", "Y", "O", "De", "En", "The", "A", "An", "And", "Or", "If", "It", "I", "We", "You")
NEGATIONS = ("no", "not", "never", "n't", "dont", "don't", "doesnt", "doesn't", "isnt", "isn't", "nunca", "sin", "odio", "hate", "tampoco")

SPACES = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2028}\x{2029}]"


def matches_any(text: Column, patterns: tuple[str, ...], flags: str = "(?i)") -> Column:
    """Whether one of the patterns is found; one regular expression."""
    return text.rlike(flags + "|".join(f"(?:{p})" for p in patterns))


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def is_noise(text: Column) -> Column:
    """Operational noise: 16 characters or more, and one of the patterns."""
    return (F.char_length(stripped(text)) >= 16) & matches_any(stripped(text), NOISE)


def is_noise_old(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    # every pattern of NOISE_OLD holds one of these, and the softer ones ask for one
    named = low.contains("sandbox") | low.contains("exec") | low.contains("ejecutor")
    return named & (F.char_length(stripped(text)) >= 16) & (matches_any(low, NOISE_OLD) | matches_any(low, NOISE_OLD_SOFT))


def is_report(text: Column) -> Column:
    """An automated report: 10 characters or more, and one of the patterns."""
    return (F.char_length(stripped(text)) >= 10) & matches_any(stripped(text), REPORTS)


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty; ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def injection_hits(text: Column, patterns=INJECTION) -> Column:
    """Numbers of the patterns found."""
    t = F.coalesce(text, F.lit(""))
    return F.array_compact(F.array(*[F.when(t.rlike("(?im)" + p), F.lit(k)) for k, (p, _) in enumerate(patterns)]))


def injection_level(text: Column, patterns=INJECTION) -> Column:
    """0 none to 4 critical: the highest level among the patterns found."""
    t = F.coalesce(text, F.lit(""))
    out = F.lit(0)
    for level in LEVELS[1:]:
        own = [p for p, x in patterns if x == level]
        if own:
            out = F.when(matches_any(t, tuple(own), "(?im)"), F.lit(LEVELS.index(level))).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Distinct lower-case words of letters, digits and underscores, any script."""
    return F.array_distinct(words(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)(\w+)"), F.lit(1))


def has_negation(token_set: Column) -> Column:
    return F.arrays_overlap(token_set, F.array(*[F.lit(x) for x in NEGATIONS]))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / union).otherwise(0.0)


def proper_names(text: Column) -> Column:
    """Capitalised spans that aren't stop words, 3 characters or more, in order."""
    spans = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + PROPER), F.lit(1))
    return F.filter(spans, lambda s: ~s.isin(*NOT_NAMES) & (F.char_length(s) >= 3))


def _typed(kind: str):
    return lambda name: F.struct(name.alias("name"), F.lit(kind).alias("type"))


def entities(text: Column) -> Column:
    """array<struct<name, type>>: hashtags, then mentions, then proper names;
    a name keeps its first type and place."""
    t = F.coalesce(text, F.lit(""))

    def marked(mark: str) -> Column:
        # most texts hold no mark, and needn't meet the pattern
        words = F.transform(F.regexp_extract_all(t, F.lit(rf"(?U){mark}(\w{{2,}})"), F.lit(1)), lambda x: F.lower(x))
        return F.when(t.contains(mark), words).otherwise(F.array().cast("array<string>"))

    found = F.struct(
        marked("#").alias("topic"),
        marked("@").alias("person"),
        proper_names(t).alias("concept"),
    )

    def joined(x: Column) -> Column:
        typed, seen = [], F.array().cast("array<string>")
        for kind in ("topic", "person", "concept"):
            new = F.array_except(F.array_distinct(x[kind]), seen)
            typed.append(F.transform(new, _typed(kind)))
            seen = F.concat(seen, new)
        return F.concat(*typed)

    # what was found is the one element of an array, so that no pattern is sought again for each use
    return F.transform(F.array(found), joined)[0]


def estimate_tokens(text: Column) -> Column:
    """0 for an empty text, else characters / 4, one at least."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def normal_tags(tags: Column) -> Column:
    """Trimmed, without empties and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != ""))


def has_tag(tags: Column, wanted: list[str]) -> Column:
    """Whether any wanted tag is there; no wanted tags, no filter."""
    return F.arrays_overlap(tags, F.array(*[F.lit(x) for x in wanted])) if wanted else F.lit(True)


def count_found(text: Column, needles: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a + b, [low.contains(n).cast("int") for n in needles])


def gap_key(text: Column) -> Column:
    """Lower case, anything but letters and digits a space, spaces collapsed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(gap_key(text), " ", "_")


def to_epoch(value: Column) -> Column:
    """Seconds since the epoch from a number, a numeric string or ISO 8601."""
    v = F.trim(value)
    return F.coalesce(v.try_cast("double"), F.unix_micros(F.try_to_timestamp(v)) / 1e6)


def query_terms(text: Column, stop: tuple[str, ...]) -> Column:
    """Distinct terms [a-z0-9@._-]{3,} without stop words, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9@._-]{3,})"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(x) for x in stop]).cast("array<string>"))
