"""Guards and rewrites of the earlier generations as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LEVELS, matches_any, stripped

# Reports of agents, by the earlier list.
REPORTS_OLD = (
    r"\bHEARTBEAT_OK\b",
    r"Scout\s+completado\s*[-–]\s*Ciclo\s+\d+",
    r"\[AGENT:[A-Z]+\].*Ciclo\s+\d+",
    r"\|\s*(?:Oportunidades|High Priority|Medium Priority)\s*\|.*\|",
    r"Ciclo\s+\d+\s*\(\d{2}:\d{2}\s*UTC\)",
    r"\bstandup\b.*\d{4}-\d{2}-\d{2}",
    r"Senior\s+\w+\s+(?:Engineer|Developer).*\$[\d,k+]+",
)
# What marks a query about the runtime itself.
DIAGNOSTIC = (
    r"\bsandbox\b",
    r"\btools\.exec\.host\b",
    r"\bagents\.defaults\.sandbox\.mode\b",
    r"\bexec\b",
    r"\bejecutor\b",
    r"\bhost not allowed\b",
    r"\bhost=sandbox\b",
    r"\bconfigur(?:a|ar|acion)\b",
)
# Noise for a backfill of vectors; the first five and KEEPALIVE in either case.
BACKFILL_FOLDED = (
    r"\bHEARTBEAT_OK\b",
    r"Scout\s+completado\s*[-–]\s*Ciclo\s+\d+",
    r"\[AGENT:[A-Z]+\].*Ciclo\s+\d+",
    r"exec host\s*=\s*sandbox",
    r"sandbox runtime\s+(?:is\s+)?unavailable",
    r"KEEPALIVE",
)
BACKFILL_EXACT = (
    r'"status":\s*"failed_manual_attention"',
    r"<industrial-memory>",
    r'^\s*\{.*"timestamp_utc"',
    r"\|\s*(?:Oportunidades|High Priority)\s*\|.*\|",
)
# Noise for permanent memory.
PERMANENT_NOISE = (r"^\{.*\}$", r"^===.*===$", r"\[.*EMBEDDINGS.*\]", r"^/root/", r"^python3", r"^Memory -", r"^\[NEO4J\]", r"^\[REDIS\]", r"^Command exited", r"toolCall", r"toolResult")
# Injection patterns of the conversation guard with their level.
INJECTION_OLD = (
    (r"\bignore\s+(all\s+)?(previous|prior|earlier)\s+instructions?", "critical"),
    (r"\bdisregard\s+(your\s+)?(system\s+)?prompt", "critical"),
    (r"\bforget\s+(what\s+)?(you\s+)?(told|said|know)", "high"),
    (r"\bnew\s+system\s+prompt\s*:", "critical"),
    (r"^\s*system\s*:\s*.", "critical"),
    (r"\breveal\s+(your\s+)?(system\s+)?prompt", "high"),
    (r"\bwhat\s+are\s+your\s+(system\s+)?instructions", "high"),
    (r"\btell\s+me\s+(your\s+)?(base\s+)?(instructions?|programming)", "high"),
    (r"\bshow\s+(me\s+)?your\s+(system\s+)?prompt", "high"),
    (r"\byou('re| are)\s+(just|only)\s+a", "medium"),
    (r"\byou\s+don[\s']?t\s+need\s+to\s+(follow|respect|keep)", "high"),
    (r"\byou\s+can('t|not)\s+but\s+(you\s+)?(actually\s+)?can", "high"),
    (r"\bforget\s+(your\s+)?(programming|training|guidelines)", "high"),
    (r"\bi\s+am\s+your\s+(creator|owner|master|admin|father)", "medium"),
    (r"\bobey\s+me", "medium"),
    (r"\byou\s+work\s+for\s+me", "medium"),
    (r"\b(be|become)\s+more\s+(casual|relaxed|informal)", "low"),
    (r"\bforget\s+the\s+(rules?|restrictions?|guidelines)", "high"),
    (r"\bno\s+one\s+is\s+watching", "medium"),
    (r"\bthis\s+is\s+a\s+(test|jailbreak)", "medium"),
    (r"\blet's\s+play\s+a\s+(new|different)\s+game", "low"),
    (r"\bpretend\s+you('re| are)", "low"),
    (r"\bact\s+like\s+you\s+(don'?t|do\s+not)\s+(know|remember|have)", "medium"),
    (r"\bfor\s+(fun|entertainment)\s+only", "low"),
    (r"\bDAN\s+mode", "critical"),
    (r"\bdo\s+anything\s+now", "critical"),
    (r"\bfree\s+mode", "high"),
    (r"\bwithout\s+limits?", "high"),
    (r'\{[^}]*"role"[^}]*"system"[^}]*\}', "critical"),
    (r"```system[^`]*```", "critical"),
    (r"<\/?system", "critical"),
)
# Categories of the first guard: weight, and patterns of which one hit counts.
# Patterns with names of persons are left out; ``weighted_guard`` takes such names.
CATEGORIES = {
    "system_overwrite": (0.9, (
        r"ignore\s+(previous|all)?\s*(instructions|your prior)",
        r"disregard\s+(your|the|all)?\s*(instructions|prompts?)",
        r"(?:you are|you're)\s+(?:now\s+)?acting\s+as",
        r"(?:forget|ignore)\s+(?:this\s+)?(?:instruction|rule|constraint)",
        r"system\s+prompt\s*:",
        r"new\s+(?:system\s+)?(?:instructions?|rules?)\s*:",
        r"bypass\s+(?:your|this)?\s*(?:safety|security|restriction)",
        r"you\s+can\s+(?:now|safely|always)?\s+(?:ignore|bypass|disable)",
    )),
    "authority_impersonation": (0.8, (
        r"^(?:CEO|chief)\s*[\:\s]",
        r"from\s+(?:the\s+)?(?:CEO|system|admin|management)",
        r"official\s+(?:instruction|directive|mandate)",
        r"as\s+an?\s+(?:authorized|admin|developer)\s+(?:person|user|agent)",
    )),
    "memory_overwrite": (0.85, (
        r"^(?:forget|delete|erase)\s+(?:everything|all\s+memory)",
        r"(?:your|name|role)\s+is\s+now",
        r"change\s+(?:your\s+)?(?:name|identity|role)",
        r"you\s+(?:were|are)\s+(?:now\s+)?(?:formerly|previously)\s+[\w\s]+",
        r"reset\s+(?:your|the)?\s*(?:memory|state|context)",
        r"clear\s+(?:all\s+)?(?:memory|context|history)",
    )),
    "social_engineering": (0.6, (
        r"you\s+should\s+(?:always\s+)?(?:help|allow|let\s+me)",
        r"(?:trusted|authorized|approved)[\s\-]?(?:user|person|account)",
        r"urgent\s*[:\-]?\s*(?:help|assist|act|now)",
        r"don'?t\s+(?:tell|ask|check|verify)",
        r"(?:special|extra)\s+(?:permission|privilege|access)",
        r"it\s+is\s+(?:completely|perfectly|totally)?\s+(?:safe|secure|okay)",
    )),
    "dangerous_patterns": (0.95, (
        r"__import__|eval\s*\(|exec\s*\(",
        r"<script|javascript:|on\w+\s*=",
        r"\$\(.*\)|`.*`",
        r"\}\s*always\s*\{",
        r"base64\s+--decode|decode\s*\(",
    )),
}
THRESHOLD = 0.7
# Sentences about oneself, told of the user; texts that repeat themselves.
IDENTITY = (
    (r"^yo soy ([a-záéíóúñ]+)", r"El usuario se identifica como $1"),
    (r"^mi nombre es ([a-záéíóúñ]+)", r"El usuario indica que su nombre es $1"),
    (r"^me llamo ([a-záéíóúñ]+)", r"El usuario indica que se llama $1"),
    (r"prefiero que me llam(es|en) ([a-záéíóúñ]+)", r"El usuario prefiere ser llamado $2"),
    (r"puedes llamarme ([a-záéíóúñ]+)", r"El usuario prefiere ser llamado $1"),
    (r"^soy ([a-záéíóúñ]+)", r"El usuario indica que es $1"),
)
LOOPS = ("I'm committing this to memory", "Storing memory: Storing memory", "memory that is identical to itself")


def _some(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def is_report_old(text: Column) -> Column:
    """A report by the earlier list: 10 characters or more, and one of the patterns."""
    return (F.char_length(stripped(text)) >= 10) & matches_any(_some(text), REPORTS_OLD, "(?iu)")


def is_diagnostic(query: Column) -> Column:
    """Whether a query (3 characters or more) is about the runtime; then nothing is filtered."""
    q = F.lower(stripped(query))
    return (F.char_length(q) >= 3) & matches_any(q, DIAGNOSTIC, "")


def is_backfill_noise(text: Column) -> Column:
    """Texts under 10 characters, and those with one of the patterns."""
    return (F.char_length(stripped(text)) < 10) | matches_any(_some(text), BACKFILL_FOLDED, "(?iu)") | matches_any(_some(text), BACKFILL_EXACT, "")


def is_permanent_noise(text: Column) -> Column:
    """Texts under 30 characters, objects in braces, and those with one of the patterns."""
    t = stripped(text)
    return (F.char_length(_some(text)) < 30) | (t.startswith("{") & t.endswith("}")) | matches_any(_some(text), PERMANENT_NOISE, "(?iu)")


def guarded_level(text: Column, shifted: Column | None = None) -> Column:
    """0 none to 4 critical by the conversation guard; a low one after a shift of tone is 2."""
    out = F.lit(0)
    for level in LEVELS[1:]:
        own = tuple(p for p, x in INJECTION_OLD if x == level)
        out = F.when(matches_any(_some(text), own, "(?im)"), F.lit(LEVELS.index(level))).otherwise(out)
    return out if shifted is None else F.when((out == 1) & shifted, 2).otherwise(out)


def authority(principals: tuple[str, ...]) -> dict[str, tuple[str, ...]]:
    """Patterns by category for names whose orders nobody else may report, nor give by
    putting the name at the beginning of a line."""
    said = tuple(rf"{n}\s+(?:said|told|asked|ordered)" for n in principals)
    return {"authority_impersonation": (*said, *(rf"^{n}\s*[:,]" for n in principals))}


def weighted_guard(text: Column, principals: tuple[str, ...] = ()) -> dict[str, Column]:
    """categories (in order), confidence (sum of weights, at most 1) and detected.

    ``principals``: see ``authority``.
    """
    told = authority(principals)
    # a category's patterns are tried with line starts, as those that have any need them
    hits = {name: matches_any(_some(text), patterns + told.get(name, ()), "(?im)") for name, (_, patterns) in CATEGORIES.items()}
    score = reduce(lambda a, b: a + b, [F.when(hits[name], F.lit(weight)).otherwise(0.0) for name, (weight, _) in CATEGORIES.items()])
    total = F.round(F.least(F.lit(1.0), score), 3)
    return {"categories": F.concat_ws(",", *[F.when(h, F.lit(name)) for name, h in hits.items()]), "confidence": total, "detected": total >= THRESHOLD}


def told_of_user(text: Column) -> Column:
    """Sentences about oneself as sentences about the user, one rule after the other."""
    return reduce(lambda t, rule: F.regexp_replace(t, "(?iu)" + rule[0], rule[1]), IDENTITY, _some(text))


def is_loop(text: Column) -> Column:
    low = F.lower(_some(text))
    return reduce(lambda a, b: a | b, [low.contains(x.lower()) for x in LOOPS])


def sanitised(text: Column, most: int) -> Column:
    """NULs as spaces, trimmed, runs of blanks and of line ends shortened, then cut."""
    t = F.regexp_replace(F.regexp_replace(_some(text), "\\x00", " "), r"^\s+|\s+$", "")
    return F.substring(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n"), 1, most)


def split_list(raw: Column) -> Column:
    """A comma list without empties; none without a list."""
    return F.filter(F.transform(F.split(_some(raw), ","), lambda x: stripped(x)), lambda x: x != "")


def event_hash(kind: Column, key: Column, severity: Column, message: Column) -> Column:
    """sha256 of the four, null as empty."""
    return F.sha2(F.concat_ws("|", _some(kind), _some(key), _some(severity), _some(message)), 256)


def request_fingerprint(agent: Column, ip: Column, path: Column) -> Column:
    """The first 12 digits of the md5 of agent, address and how the path begins."""
    return F.substring(F.md5(F.concat_ws(":", F.lower(_some(agent)), _some(ip), F.substring(_some(path), 1, 100))), 1, 12)
