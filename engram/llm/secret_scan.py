"""Secret scans: patterns, and a battery of randomness tests.

Pattern spans are found with built-in regular expressions.  The method adds
tokens that look random.  Each candidate's encoding is inferred, and three
statistics test whether its characters are independent and uniform over that
alphabet: chi-squared uniformity, the runs test about the middle of the
alphabet, and lag-1 serial correlation.  A secret is a token that passes this
battery and that text would not give.  That second p-value (1 where the battery
fails) joins three scores of equal weight: how far below text-like tokens the
count of equal pairs lies, how often the class of character (small, capital,
digit) changes, and how rarely the corpus's own words have one letter after
another.  It goes through a length-weighted Benjamini-Hochberg step over all
candidates of the corpus, so the secrets reported are the discoveries, of which a
bounded share is text.

Built-in expressions only; p-values are counted in a fixed number of bins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import durable

# The base patterns, in the order kinds are listed.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"

#: Share of false discoveries, level of the battery, and bins of -log10(p).
RATE, LEVEL, BINS = 0.05, 0.01, 400
#: Chance that two characters of a text-like token are equal (at least twice that of
#: a uniform one), and that three are, as a multiple of its square.
TEXT_PAIRS, TEXT_TRIPLES = 0.065, 1.28
#: Chance that the class changes from one character of a text-like token to the next,
#: and how much wider than independent ones its changes, and letters, are spread.
TEXT_CHANGES, WIDER = 0.25, 1.5
#: Matches of a text that are placed together; see ``_spans``.
CHUNK = 256

# The alphabets of usual encodings.
_ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base58": "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
_SPANS = "array<struct<start:bigint,rank:int,kind:string,stop:bigint,token:string>>"


def _spans(text: str, pattern: str, kind: str, keep: str = "true") -> str:
    """SQL for the array of (start, rank, kind, end, token) of a pattern.

    The gaps between matches are what ``split`` leaves, so a match starts where
    the gaps and matches before it end.  Matches are placed in chunks: appending
    to one array would cost the square of their number.
    """
    rank = ["assign", "access", "hex", "random"].index(kind)
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found = f"regexp_extract_all({text}, '{quoted}', 0)"
    value = f"regexp_extract_all({text}, '{quoted}', 2)" if kind == "assign" else found
    gaps = f"split({text}, '{quoted}', -1)"
    matches = f"zip_with(zip_with({found}, {value}, (m, v) -> named_struct('m', m, 'v', v)), {gaps}, (y, g) -> named_struct('m', y.m, 'v', y.v, 'g', char_length(g), 'n', char_length(y.m)))"
    own = f"filter(slice(p, k * {CHUNK} + 1, {CHUNK}), x -> x.m IS NOT NULL)"
    chunks = f"sequence(0, (size(p) - 1) div {CHUNK})"
    ends = f"transform({chunks}, k -> aggregate({own}, 0L, (s, x) -> s + x.g + x.n))"
    begins = f"aggregate({ends}, named_struct('at', 0L, 'out', cast(array() AS array<bigint>)), (s, x) -> named_struct('at', s.at + x, 'out', array_append(s.out, s.at)), s -> s.out)"
    span = f"named_struct('start', s.at + x.g, 'rank', {rank}, 'kind', '{kind}', 'stop', s.at + x.g + x.n, 'token', x.m)"
    placed = f"aggregate({own}, named_struct('at', b, 'out', cast(array() AS {_SPANS})), (s, x) -> named_struct('at', s.at + x.g + x.n, 'out', CASE WHEN {keep} THEN array_append(s.out, {span}) ELSE s.out END), s -> s.out)"
    spans = f"flatten(flatten(transform(array({matches}), p -> zip_with({chunks}, {begins}, (k, b) -> {placed}))))"
    return f"CASE WHEN {text} rlike '{quoted}' THEN {spans} ELSE cast(array() AS {_SPANS}) END"


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, to about 1e-4 of its value near 0."""
    y = F.greatest(F.least(z, F.lit(8.0)), F.lit(-8.0))
    return 1 / (1 + F.exp(1.5976 * y + 0.07056 * y * y * y))


def letters(texts: DataFrame) -> tuple[list[float], float, float]:
    """Bits of each letter after each (26 lines of 26) by the words of all texts, and
    their mean and deviation in words."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("k"))
    each = words.select("k", "word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
    # 676 rows at most
    found = each.groupBy(F.substr("word", F.col("at"), F.lit(2)).alias("pair")).agg(F.sum("k").alias("k")).collect()
    counts = [[0] * 26 for _ in range(26)]
    for r in found:
        counts[ord(r["pair"][0]) - 97][ord(r["pair"][1]) - 97] = r["k"]
    bits = [[-math.log2((k + 0.5) / (sum(line) + 13)) for k in line] for line in counts]
    pairs = [(k, b) for line, own in zip(counts, bits) for k, b in zip(line, own)]
    total = sum(k for k, _ in pairs)
    if not total:
        return [math.log2(26)] * 676, math.log2(26), 1.0
    mean = sum(k * b for k, b in pairs) / total
    return [b for line in bits for b in line], mean, max(1.0, math.sqrt(sum(k * (b - mean) ** 2 for k, b in pairs) / total))


def battery(tokens: DataFrame, model: tuple[list[float], float, float]) -> DataFrame:
    """``tokens`` (token) with encoding, n, chi_z, runs_z, serial_z, p and text_p added.

    p is the battery's, small for what is not random; text_p is small for what is
    not text-like, by ``model`` (see ``letters``).
    """
    low, up = F.lower("token"), F.upper("token")
    bare = F.regexp_replace("token", "=+$", "")
    single = (F.col("token") == low) | (F.col("token") == up)
    encoding = (
        F.when(single & low.rlike("^[0-9a-f]+$"), "hex").when(bare.rlike("^[A-Z2-7]+$"), "base32").when(single & low.rlike("^[0-9a-z]+$"), "base36")
        .when(F.col("token").rlike("^[1-9A-HJ-NP-Za-km-z]+$"), "base58").when(bare.rlike("^[A-Za-z0-9_-]+$"), "base64url").otherwise("base64")
    )
    t = tokens.withColumn("encoding", encoding)
    # what mixes both variants of base64 counts as the plain one
    plain = F.when(F.col("encoding").isin("hex", "base36"), low).when(F.col("encoding") == "base64", F.translate(bare, "-_=", "+/")).otherwise(bare)
    alphabet = F.lit(_ALPHABETS["base64"])
    for name, chars in _ALPHABETS.items():
        alphabet = F.when(F.col("encoding") == name, chars).otherwise(alphabet)
    t = t.withColumns({"plain": plain, "alphabet": alphabet}).withColumn("a", F.char_length("alphabet").cast("double"))
    t = t.withColumn("codes", F.expr("transform(split(plain, ''), c -> cast(instr(alphabet, c) - 1 AS double))"))
    t = t.withColumn("n", F.size("codes").cast("double"))
    squares = F.expr("aggregate(transform(split(alphabet, ''), c -> pow(cast(char_length(plain) - char_length(replace(plain, c, '')) AS double), 2)), 0D, (s, x) -> s + x)")
    chi = F.col("a") / F.col("n") * squares - F.col("n")
    # equal pairs, against their number in a text-like token of this length
    pairs, n, same = (squares - F.col("n")) / 2, F.col("n"), F.greatest(F.lit(TEXT_PAIRS), 2 / F.col("a"))
    usual = n * (n - 1) / 2
    wide = usual * (same - same * same) + n * (n - 1) * (n - 2) * (TEXT_TRIPLES - 1) * same * same
    equal_z = (usual * same - pairs) / F.sqrt(F.greatest(wide, F.lit(1e-9)))
    # small, capital, digit; other characters are none
    kinds = F.expr("transform(split(regexp_replace(token, '[^A-Za-z0-9]', ''), ''), c -> CASE WHEN c >= 'a' THEN 2 WHEN c >= 'A' THEN 1 ELSE 0 END)")
    t = t.withColumn("kinds", kinds)
    changes = F.expr("cast(aggregate(zip_with(slice(kinds, 2, size(kinds) - 1), slice(kinds, 1, size(kinds) - 1), (x, y) -> CASE WHEN x != y THEN 1 ELSE 0 END), 0, (s, x) -> s + x) AS double)")
    steps = F.greatest(F.size("kinds") - 1, F.lit(1)).cast("double")
    change_z = (changes - steps * TEXT_CHANGES) / (F.sqrt(steps * TEXT_CHANGES * (1 - TEXT_CHANGES)) * WIDER)
    bits, mean_bits, spread_bits = model
    own = F.transform(F.split(low, ""), lambda c: F.ascii(c) - 97)
    t = t.withColumns({"own": own, "bits": F.lit(bits)})
    known = "x BETWEEN 0 AND 25 AND y BETWEEN 0 AND 25"
    rare = F.expr(f"filter(zip_with(slice(own, 1, size(own) - 1), slice(own, 2, size(own) - 1), (x, y) -> CASE WHEN {known} THEN element_at(bits, x * 26 + y + 1) END), b -> b IS NOT NULL)")
    t = t.withColumn("rare", rare)
    m = F.size("rare").cast("double")
    rare_z = F.when(m > 0, (F.aggregate("rare", F.lit(0.0), lambda x, y: x + y) - m * mean_bits) / (F.sqrt(m) * spread_bits * WIDER)).otherwise(0.0)
    t = t.withColumn("text_p", _tail((equal_z + change_z + rare_z) / 3**0.5)).drop("kinds", "own", "bits", "rare")
    t = t.withColumn("chi_z", (chi - (F.col("a") - 1)) / F.sqrt(2 * (F.col("a") - 1) * (F.col("n") - 1) / F.col("n")))
    middle = "(a - 1) / 2"
    runs = F.expr(f"1D + aggregate(zip_with(slice(codes, 2, size(codes) - 1), slice(codes, 1, size(codes) - 1), (x, y) -> CASE WHEN (x > {middle}) != (y > {middle}) THEN 1D ELSE 0D END), 0D, (s, x) -> s + x)")
    above = F.expr(f"cast(size(filter(codes, x -> x > {middle})) AS double)")
    t = t.withColumns({"runs": runs, "above": above}).withColumn("below", F.col("n") - F.col("above"))
    both = 2 * F.col("above") * F.col("below")
    spread = F.sqrt(F.greatest(both * (both - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1)), F.lit(1e-9)))
    t = t.withColumn("runs_z", F.when(both > 0, (F.col("runs") - (both / F.col("n") + 1)) / spread).otherwise(F.sqrt("n")))
    t = t.withColumn("mean", F.expr("aggregate(codes, 0D, (s, x) -> s + x) / n"))
    lag = F.expr("aggregate(zip_with(slice(codes, 2, size(codes) - 1), slice(codes, 1, size(codes) - 1), (x, y) -> (x - mean) * (y - mean)), 0D, (s, x) -> s + x)")
    variance = F.expr("aggregate(codes, 0D, (s, x) -> s + (x - mean) * (x - mean))")
    t = t.withColumns({"lag": lag, "variance": variance})
    t = t.withColumn("serial_z", F.when(F.col("variance") > 0, F.col("lag") / F.col("variance") * F.sqrt("n") + 1 / F.sqrt("n")).otherwise(F.sqrt("n")))
    # the sum of three squares, by the cube-root normal approximation
    up = F.greatest("chi_z", F.lit(0.0))
    q = (up * up + F.col("runs_z") * F.col("runs_z") + F.col("serial_z") * F.col("serial_z")) / 3
    z = (F.cbrt(q) - (1 - 2 / 27)) / F.sqrt(F.lit(2 / 27))
    return t.withColumn("p", F.greatest(_tail(z), F.lit(1e-16))).drop("plain", "alphabet", "codes", "runs", "above", "below", "mean", "lag", "variance")


def _found_from(tested: DataFrame) -> int:
    """The bin from which tokens are discoveries.

    All tokens of a bin count as its largest p-value, so the step errs on the side
    of fewer discoveries.
    """
    each = tested.groupBy("bin").agg(F.count("*").alias("k"))
    # BINS + 1 rows at most
    down = W.orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    level = each.withColumns({"upto": F.sum("k").over(down), "all": F.sum("k").over(W.partitionBy())}).filter(F.pow(10.0, -F.col("bin") / 20) * F.col("all") <= RATE * F.col("upto")).agg(F.min("bin")).first()[0]
    return BINS + 1 if level is None else level


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex,
    base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, ordered by start,
    then kind as listed.  A null text counts as empty.  Rows may repeat.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    found = rows.select("doc_id", F.expr(_spans("text", ASSIGN, "assign", "char_length(x.v) >= 8")).alias("assign"), F.expr(_spans("text", ACCESS, "access", "char_length(x.v) >= 16")).alias("access"), F.expr(_spans("text", HEX, "hex")).alias("hex"), F.expr(_spans("text", TOKEN, "random", "(x.v rlike '[0-9]' AND x.v rlike '[A-Za-z]') OR (x.v rlike '[a-z]' AND x.v rlike '[A-Z]')")).alias("tokens"))
    found = durable(found, "spans")
    tested = battery(found.select(F.explode("tokens.token").alias("token")).distinct(), letters(rows))
    sums = tested.groupBy("encoding").agg((F.sum("n") / F.count("*")).alias("mean_n"))
    own = F.when(F.col("p") >= LEVEL, F.col("text_p")).otherwise(1.0)
    weighted = F.least(F.lit(1.0), own * F.col("mean_n") / F.col("n"))
    bin_ = F.least(F.floor(-F.log10(F.greatest(weighted, F.lit(1e-30))) * 20), F.lit(BINS)).cast("int")
    tested = durable(tested.join(sums, "encoding").select("token", "encoding", "n", "p", bin_.alias("bin")), "tested")
    looks = tested.filter(F.col("bin") >= _found_from(tested)).select("token")
    # documents meet the random tokens by the token, not by a set sent to all
    hits = found.select("doc_id", F.explode("tokens").alias("x"), F.xxhash64("tokens").alias("key")).join(looks, F.col("x.token") == looks["token"]).groupBy("doc_id", "key").agg(F.collect_set("x").alias("extra"))
    out = found.withColumn("key", F.xxhash64("tokens")).alias("f").join(hits.alias("h"), F.col("f.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("f.key") == F.col("h.key")), "left")
    write = "array_join(transform(sort_array({}), x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')"
    base = "concat(assign, access, hex)"
    # random spans that a base span overlaps are the same secret
    extra = f"filter(coalesce(extra, cast(array() AS {_SPANS})), x -> NOT exists({base}, b -> b.start < x.stop AND x.start < b.stop))"
    return out.select("f.doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"), F.sha2(F.expr(write.format(base)), 256).alias("base_sha256"), F.expr(write.format(f"concat({base}, {extra})")).alias("spans"))
