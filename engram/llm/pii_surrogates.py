"""PII surrogates: keyed, type-consistent replacements of personal data.

Each detected value is replaced by the value of a keyed permutation over its
own format: digits go to digits, letters to letters of their case, script and
vowel class, everything else stays.  So a surrogate has the type and shape of
what it replaces (a card or an IBAN keeps its check digits valid, an
address stays in range), the same value gets the same surrogate everywhere, and different values
of one shape never share one.  A name is replaced part by part: a usual first or
last name by another one of its list, so of its gender; any other keeps its
ending, and never becomes a listed one.  A name is found after (or before) a title,
and without one where a listed first and a listed last name stand together.  Where
it stands after a title, its other mentions in the text, whole or in part, are
replaced alike.

No value is its own surrogate: the permutation of each shape is a keyed shift
without fixed points, hidden by a keyed change of places before it and its
inverse after it.  A check over all distinct values confirms this.  The key is
the caller's: who has it can turn surrogates back.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import durable

ROUNDS = 8

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}"
_NUMBER = re.compile(rf"(?<![\w.+-])(?:(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d))(?![\d]|\.\d)|(?P<ssn>\d{{3}}-\d{{2}}-\d{{4}})(?!\d)|(?P<card>\d{{4}}[ -]?\d{{4}}[ -]?\d{{4}}[ -]?\d{{1,7}}|\d{{13,19}})(?!\d)|(?P<phone>{_PHONE})(?!\d))|(?P<phone2>(?<!\d){_PHONE})(?!\d)")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
# Titles before a person's name, by script, and after it.
TITLES = "Mr Mrs Ms Miss Dr Herr Frau Monsieur Madame Mademoiselle Señor Señora Señorita Sr Sra Mme Mlle".split()
CYRILLIC_TITLES = "господин госпожа г-н г-жа Господин Госпожа Г-н Г-жа".split()
GREEK_TITLES = "κύριος κυρία Κύριος Κυρία".split()
ARABIC_TITLES = "السيدة السيد الدكتورة الدكتور".split()
CHINESE_TITLES = "先生 女士 小姐 太太".split()
JAPANESE_TITLES = "さん 様".split()
CHINESE_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡林郭何高罗郑梁谢宋唐许邓冯韩曹曾彭萧蔡潘田董袁于余叶蒋杜苏魏程吕丁沈任姚卢傅钟姜崔谭廖范汪陆金石戴贾韦夏邱方侯邹熊孟秦白江阎薛尹段雷黎史龙陶贺顾毛郝龚邵万钱严武孔"
# Usual names, by gender; those of both become one another, so that they
# suit any title.
EITHER = "Alex Andrea Camille Charlie Chris Claude Dominique Jean Jordan Kim Robin Sascha".split()
FEMALE = "Alice Amelia Anna Anne Barbara Beatriz Carla Carmen Carolina Caroline Charlotte Claire Claudia Cristina Diana Dolores Elena Elizabeth Emily Emma Eva Florence Francesca Gabriela Helena Ines Irene Isabel Jane Jennifer Jessica Julia Karen Katharina Laura Lisa Lucia Luisa Margaret Maria Marie Marta Mary Monica Nadine Natalia Olga Patricia Paula Petra Rachel Rosa Sabine Sandra Sara Sarah Silvia Sofia Sophie Susan Teresa Ursula Valentina Veronica Victoria".split()
MALE = "Adam Albert Alexander Andreas Andrew Anthony Antonio Arthur Benjamin Bernard Carlos Charles Christian Daniel David Diego Edward Enrique Ernesto Fernando Francisco Frank Frederick George Gerard Hans Henry Hugo Ignacio James Javier John Jorge Jose Joseph Juan Julian Karl Klaus Laurent Louis Lucas Luis Manuel Marco Mark Martin Matthew Maurice Michael Michel Miguel Oliver Oscar Pablo Patrick Paul Pedro Peter Philip Pierre Rafael Raymond Richard Robert Roberto Samuel Sebastian Stefan Stephen Thomas Victor Vincent Walter William Wolfgang".split()
SURNAMES = "Adams Allen Alvarez Anderson Bailey Baker Bauer Becker Bennett Bernard Bonnet Brown Campbell Carter Castillo Castro Clark Collins Cooper Cruz Davis Delgado Diaz Dubois Durand Edwards Evans Fernandez Fischer Flores Garcia Girard Gomez Gonzalez Green Gutierrez Hall Harris Hernandez Hill Hoffmann Hughes Jackson Jimenez Johnson Jones Keller King Klein Koch Lambert Lefebvre Leroy Lewis Lopez Martinez Meyer Miller Mitchell Moore Morales Moreau Morgan Morris Mueller Murphy Navarro Nelson Ortega Parker Perez Phillips Ramirez Ramos Richter Rivera Roberts Robinson Rodriguez Romero Roussel Ruiz Sanchez Schmidt Schneider Schulz Scott Silva Smith Suarez Taylor Thompson Torres Turner Vargas Vazquez Wagner Walker Watson Weber White Wilson Wood Wright Young Zimmermann".split()

_LATIN = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
_NAMES = [re.compile(rf"\b(?:{'|'.join(titles)})\.? ({part}(?:[ -]{part})*)") for titles, part in ((TITLES, _LATIN), (CYRILLIC_TITLES, "[А-ЯЁ][а-яё]+"), (GREEK_TITLES, "[Α-ΡΣ-ΫΆΈΉΊΌΎΏ][α-ωάέήίόύώϊϋΐΰ]+"))]
_NAMES.append(re.compile(rf"(?<!\w)(?:{'|'.join(ARABIC_TITLES)}) ([\u0621-\u063A\u0641-\u064A]+(?: [\u0621-\u063A\u0641-\u064A]+)?)"))
_NAMES.append(re.compile(rf"([{CHINESE_SURNAMES}][\u4E00-\u9FFF]{{1,2}}?)(?={'|'.join(CHINESE_TITLES)})"))
_NAMES.append(re.compile(rf"([\u4E00-\u9FFF]{{2,4}})(?={'|'.join(JAPANESE_TITLES)})"))
_TITLE = re.compile("|".join(TITLES + CYRILLIC_TITLES + GREEK_TITLES + ARABIC_TITLES + CHINESE_TITLES + JAPANESE_TITLES))
_CALLED = re.compile(r"(?i:\b(?:phone|tel|telephone|call|mobile|cell|fax|text)\b)[:.#]?\s*(?:(?:me|us|is|at|on|number)\s+){0,3}([2-9]\d{2}[2-9]\d{6})(?!\d)")

_CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àáâãäåæèéêëìíîïòóôõöøùúûüýÿ", "ñçßðþ", "ÀÁÂÃÄÅÆÈÉÊËÌÍÎÏÒÓÔÕÖØÙÚÛÜÝ", "ÑÇÐÞ"]
_CLASSES += ["аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώϊϋΐΰ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "ΆΈΉΊΌΎΏ"]
_CLASSES += ["ابتثجحخدذرزسشصضطظعغفقكلمنهوي", CHINESE_SURNAMES, "".join(chr(c) for c in range(0x4E00, 0xA000) if chr(c) not in CHINESE_SURNAMES)]
# the digits of each other script: the detectors take them as well
_CLASSES += ["".join(chr(c + k) for k in range(10)) for c in range(128, sys.maxunicode + 1) if unicodedata.decimal(chr(c), None) == 0]
_CLASS = {c: k for k, chars in enumerate(_CLASSES) for c in chars}
_PLACE = {c: k for chars in _CLASSES for k, c in enumerate(chars)}
_LISTS = {name: kind for kind, names in (("surname", SURNAMES), ("male", MALE), ("female", FEMALE), ("either", EITHER)) for name in names}
_FIRST, _LAST = frozenset(MALE + FEMALE + EITHER), frozenset(SURNAMES)
#: A first name, perhaps an initial, and a last name, looked up in the lists.
_PAIR = re.compile(r"\b(?=([A-Z][a-z]+)(?: [A-Z]\.)?[ -]([A-Z][a-z]+)\b)")
_HEX = "[0-9A-Fa-f]{1,4}"
_IPV6 = re.compile(rf"(?<![\w:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX})*)?::(?:{_HEX}(?::{_HEX})*)?)(?![\w:])")


def _stream(seed: bytes, n: int, key: bytes) -> list[int]:
    """n keyed numbers of 32 bits."""
    stream = b"".join(hashlib.blake2b(seed + block.to_bytes(4, "little"), key=key, digest_size=64).digest() for block in range(-(-n // 16)))
    return [int.from_bytes(stream[4 * j : 4 * j + 4], "little") for j in range(n)]


def _feistel(values: list[int], sizes: list[int], key: bytes, sign: int) -> list[int]:
    """A keyed permutation of mixed-radix tuples on two halves; its inverse at sign -1."""
    values = list(values)
    halves = [range(0, len(values), 2), range(1, len(values), 2)]
    for r in range(ROUNDS)[::sign]:
        to, by = halves[r % 2], halves[1 - r % 2]
        seed = bytes([r]) + b"".join(values[k].to_bytes(2, "little") for k in by)
        for k, x in zip(to, _stream(seed, len(to), key)):
            values[k] = (values[k] + sign * x) % sizes[k]
    return values


def _permute(values: list[int], sizes: list[int], key: bytes) -> list[int]:
    """A keyed permutation of mixed-radix tuples that moves each one; sizes are 2 at least."""
    moved = _feistel(values, sizes, key, 1)
    # each place moves by less than its size, so no tuple stays; the inverse keeps that
    steps = _stream(bytes([ROUNDS]), len(sizes), key)
    return _feistel([(v + 1 + x % (n - 1)) % n for v, x, n in zip(moved, steps, sizes)], sizes, key, -1)


def _shape(text: str, key: bytes, kind: str, fixed: int = 0, ending: int = 0) -> str:
    """Permute the letters and digits of a text within their classes.

    Where no other character is free, those of the fixed start and ending are;
    a text without any letter or digit stays as it is (no detector takes one).
    """
    free = [k for k, c in enumerate(text) if c in _CLASS]
    at = [k for k in free if fixed <= k < len(text) - ending] or free
    classes = [_CLASS[text[k]] for k in at]
    # the shape takes part in the key, so that no two shapes move alike
    shape = hashlib.blake2b(repr((kind, classes)).encode(), key=key, digest_size=32).digest()
    new = _permute([_PLACE[text[k]] for k in at], [len(_CLASSES[c]) for c in classes], shape)
    out = list(text)
    for k, c, v in zip(at, classes, new):
        out[k] = _CLASSES[c][v]
    return "".join(out)


def _address(value: str, key: bytes) -> str:
    """Numbers of plain digits move within 0..255, digits of other scripts within theirs.

    The detector takes the latter only where any digit is in range.
    """
    tokens = [y for x in re.split(r"(\.)", value) for y in ([(x, x != ".")] if x.isascii() else [(c, not c.isascii()) for c in x])]
    free = [x for x, moves in tokens if moves]
    new = iter(_permute([int(x) for x in free], [256 if x.isascii() else 10 for x in free], key))
    return "".join(x if not moves else str(next(new)) if x.isascii() else _CLASSES[_CLASS[x]][next(new)] for x, moves in tokens)


@lru_cache(maxsize=4)
def _listed(key: bytes) -> dict[str, str]:
    """Each listed name's surrogate: the next one of its list, in keyed order."""
    out = {}
    for kind in sorted(set(_LISTS.values())):
        names = sorted((n for n, k in _LISTS.items() if k == kind), key=lambda n: hashlib.blake2b(n.encode(), key=key).digest())
        out |= dict(zip(names, names[1:] + names[:1]))
    return out


def _name_part(part: str, key: bytes) -> str:
    known = _listed(key).get(part)
    if known:
        return known
    # the last letter tells gender in many languages; walk on past listed names
    new = _shape(part, key, "name", ending=1)
    while new in _LISTS:
        new = _shape(new, key, "name", ending=1)
    return new


def _check_digit(digits: str) -> int:
    """The digit that makes digits + it pass the mod-10 card check."""
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 == 0 else int(d) for k, d in enumerate(reversed(digits)))
    return -total % 10


def _iban_check(country: str, body: str) -> int:
    """The check digits that make country + digits + body valid (mod 97)."""
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _iban(value: str, key: bytes) -> str:
    """How far the check digits are from the valid ones stays as it is."""
    plain = value.replace(" ", "")
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if not check.isascii():
        return _shape(value, key, "iban", fixed=2)
    new = _shape(body, key, "iban")
    own = (_iban_check(country, new) + int(check) - _iban_check(country, body)) % 100
    chars = iter(f"{country}{own:02}{new}")
    return "".join(c if c == " " else next(chars) for c in value)


def _ipv6(value: str, key: bytes) -> str:
    """Hexadecimal digits change their values, what is left out stays so."""
    low = value.lower()
    at = [k for k, c in enumerate(low) if c != ":"]
    shape = hashlib.blake2b(repr(("ipv6", [len(g) for g in low.split(":")])).encode(), key=key, digest_size=32).digest()
    out = list(low)
    for k, v in zip(at, _permute([int(low[k], 16) for k in at], [16] * len(at), shape)):
        out[k] = f"{v:x}"
    return "".join(out).upper() if any(c.isupper() for c in value) else "".join(out)


def surrogate(kind: str, value: str, key: bytes) -> str:
    """The replacement of one value; a bijection without fixed points on the values of its shape."""
    if kind == "ip":
        return _address(value, key)
    if kind == "card":
        digits = [k for k, c in enumerate(value) if c.isdigit()]
        plain = "".join(value[k] for k in digits)
        # how far the last digit is from the valid one stays as it is
        off = (int(plain[-1]) - _check_digit(plain[:-1])) % 10
        body = _shape(plain[:-1], key, kind, fixed=1)
        last = (_check_digit(body) + off) % 10
        full, out = body + _CLASSES[_CLASS[plain[-1]]][last], list(value)
        for k, d in zip(digits, full):
            out[k] = d
        return "".join(out)
    if kind == "iban":
        return _iban(value, key)
    if kind == "ipv6":
        return _ipv6(value, key)
    if kind == "phone":
        country = re.match(r"\+\d{1,3}(?=[ (.-])", value)
        return _shape(value, key, kind, fixed=country.end() if country else 0)
    if kind == "email":
        low = value.lower()
        new = _shape(low, key, kind, ending=len(low) - low.rindex("."))
        return "".join(b.upper() if a.isupper() else b for a, b in zip(value, new))
    if kind == "name":
        return re.sub(r"[^\W\d_]+", lambda m: _name_part(m[0], key), value)
    return _shape(value, key, kind)


def _mentions(text: str, names: set[str]) -> list[tuple[int, int, str]]:
    """Where names stand again, whole or by a part of three letters or more."""
    parts = {p for n in names for p in re.split("[ -]", n) if len(p) >= 3}
    wanted = sorted(names | parts, key=len, reverse=True)
    # Chinese and Japanese names stand between other letters
    free = [n for n in wanted if "\u4e00" <= n[0] <= "\u9fff"]
    bound = [n for n in wanted if n not in free]
    forms = [re.escape(n) for n in free] + ([rf"(?<!\w)(?:{'|'.join(map(re.escape, bound))})(?!\w)"] if bound else [])
    return [(m.start(), m.end(), "name") for m in re.finditer("|".join(forms), text)]


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of personal data, by start, without overlaps."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text)]
    for m in _NUMBER.finditer(text):
        found.append((m.start(), m.end(), m.lastgroup.rstrip("2")))
    found += [(m.start(), m.end(), "iban") for m in _IBAN.finditer(text)]
    if "::" in text or text.count(":") >= 7:
        for m in _IPV6.finditer(text):
            groups = sum(g != "" for g in m[0].split(":"))
            # three groups at least, so that names with :: between them stay
            if groups == 8 if "::" not in m[0] else 3 <= groups <= 7 and m[0].count("::") == 1:
                found.append((*m.span(), "ipv6"))
    for m in _PAIR.finditer(text):
        if m[1] in _FIRST and m[2] in _LAST:
            found.append((m.start(1), m.end(2), "name"))
    found += [(*m.span(1), "phone") for m in _CALLED.finditer(text)]
    if _TITLE.search(text):
        titled = [m for form in (_NAMES[:1] if text.isascii() else _NAMES) for m in form.finditer(text)]
        if titled:
            found += [(*m.span(1), "name") for m in titled] + _mentions(text, {m[1] for m in titled})
    out: list[tuple[int, int, str]] = []
    for x in sorted(set(found), key=lambda x: (x[0], -x[1], x[2])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


#: Kinds whose capitals say nothing.
_FOLDED = ("email", "ipv6")


def _rewrite(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for x in batch.column(1):
                text = x.as_py() or ""
                parts, at, spans, seen = [], 0, [], []
                for a, b, kind in detect(text):
                    new = surrogate(kind, text[a:b], key)
                    parts += [text[at:a], new]
                    at = b
                    spans.append(f"{kind}:{a}:{b}")
                    seen.append({"kind": kind, "value": text[a:b].lower() if kind in _FOLDED else text[a:b], "new": new.lower() if kind in _FOLDED else new})
                parts.append(text[at:])
                for column, v in zip(out, ("".join(parts), len(spans), ",".join(sorted({s.split(":")[0] for s in spans})), ",".join(spans), seen)):
                    column.append(v)
            pair = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string()), ("new", pa.string())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], type=pa.string()), pa.array(out[1], type=pa.int64()), pa.array(out[2], type=pa.string()), pa.array(out[3], type=pa.string()), pa.array(out[4], type=pair)], names=["doc_id", "text", "n_entities", "kinds", "spans", "pairs"])

    return run


def collisions(pairs: DataFrame) -> int:
    """How many (kind, new) stand for more than one value, or for themselves."""
    bad = pairs.distinct().groupBy("kind", "new").agg(F.count("*").alias("k"), F.max((F.col("value") == F.col("new")).cast("int")).alias("same"))
    return bad.filter("k > 1 OR same = 1").count()


def replace(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text, n_entities, kinds, spans.

    ``text`` has every detected value replaced; ``spans`` are kind:start:end in
    code points of the original text.  ``key`` is a secret of 16 bytes or more;
    the same key gives the same surrogates.  A null text counts as empty: an
    empty text, no entities, '' as kinds and spans.  Rows may repeat and get
    equal results; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    if len(key) < 16:
        raise ValueError("a key has 16 bytes at least")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    own = hashlib.blake2b(key, digest_size=32).digest()
    out = durable(rows.mapInArrow(_rewrite(own), f"doc_id {kind}, text string, n_entities long, kinds string, spans string, pairs array<struct<kind:string,value:string,new:string>>"), "surrogates")
    if collisions(out.select(F.explode("pairs").alias("p")).select("p.*")):  # only an error of surrogate() gets here
        raise ValueError("surrogates collide")
    return out.drop("pairs")
