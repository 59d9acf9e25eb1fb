"""Chat formatting: records of any known layout to canonical turns, turns to a template.

A record is a VARIANT.  Its schema, which Spark derives, names its nested field
paths (``messages[].role``); the sorted paths that any layout knows are hashed, and
that fingerprint selects a declarative mapping, which Spark compiles to one
expression a layout.  Only schemas reach Python, never texts.

Turns become text by a template that can be read back whole::

    ### role
    text</turn>

Inside roles and texts a backslash goes before ``#``, before a backslash, and
before the slash of ``</``, so neither control string can occur there; a line break
in a role is written as backslash and ``n``.  A conversation of any length comes in
segments of bounded size, with the loss mask as places in the whole conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

HEAD, END = "### ", "</turn>\n"
#: Characters of a segment, about: it ends with the turn that fills it.
SEGMENT = 1 << 20
TRAINED = "assistant"
#: The record's column while its turns are taken out.
_RECORD = "__record"


@dataclass(frozen=True)
class Fixed:
    """A turn of one role; its text is the fields that aren't empty, by blank lines."""

    role: str
    fields: tuple[str, ...]

    def turns(self) -> Column:
        texts = F.filter(F.array(*[_text(F.try_variant_get(_RECORD, f"$.{f}", "variant")) for f in self.fields]), lambda t: t != "")
        return F.array(F.struct(F.lit(self.role).alias("role"), F.array_join(texts, "\n\n").alias("text")))


@dataclass(frozen=True)
class Row:
    """The record is a turn itself."""

    role: str
    text: str

    def turns(self) -> Column:
        return F.array(_turn(F.try_variant_get(_RECORD, f"$.{self.role}", "string"), _text(F.try_variant_get(_RECORD, f"$.{self.text}", "variant"))))


@dataclass(frozen=True)
class Listed:
    """A list of messages, in order; ``names`` translates roles."""

    at: str
    role: str
    text: str
    names: dict = field(default_factory=dict, hash=False)

    def turns(self) -> Column:
        def one(m: Column) -> Column:
            role = F.coalesce(F.try_variant_get(m, f"$.{self.role}", "string"), F.lit(""))
            for old, new in self.names.items():
                role = F.when(role == old, new).otherwise(role)
            return _turn(role, _text(F.try_variant_get(m, f"$.{self.text}", "variant")))

        found = F.try_variant_get(_RECORD, f"$.{self.at}", "array<variant>")
        return F.coalesce(F.transform(found, one), _nothing())


@dataclass(frozen=True)
class Pairs:
    """A list of exchanges, each a list with one text a role."""

    at: str
    roles: tuple[str, ...]

    def turns(self) -> Column:
        found = F.try_variant_get(_RECORD, f"$.{self.at}", "array<array<string>>")
        each = lambda p: F.array(*[_turn(F.lit(r), F.get(p, F.lit(k))) for k, r in enumerate(self.roles)])
        return F.coalesce(F.flatten(F.transform(found, each)), _nothing())


@dataclass(frozen=True)
class Layout:
    """Paths that a record must have, paths that it may have, and its turns in order;
    a part whose path is missing is left out."""

    name: str
    needs: tuple[str, ...]
    parts: tuple
    may: tuple[str, ...] = ()


_SHARED = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_PARTS = ("messages[].content[].type", "messages[].content[].text")

#: Layouts by name; no two may have the same paths.
LAYOUTS = (
    Layout("turn rows", ("role", "text"), (Row("role", "text"),)),
    Layout("messages", ("messages[].role", "messages[].content"), (Fixed("system", ("system",)), Listed("messages", "role", "content")), ("system",)),
    Layout("message parts", ("messages[].role", *_PARTS), (Fixed("system", ("system",)), Listed("messages", "role", "content")), ("system",)),
    Layout("shared", ("conversations[].from", "conversations[].value"), (Fixed("system", ("system",)), Listed("conversations", "from", "value", _SHARED)), ("system",)),
    Layout("shared messages", ("conversations[].role", "conversations[].content"), (Fixed("system", ("system",)), Listed("conversations", "role", "content")), ("system",)),
    Layout("instruction", ("instruction", "output"), (Fixed("system", ("system",)), Fixed("user", ("instruction", "input")), Fixed("assistant", ("output",))), ("system", "input")),
    Layout("instruction response", ("instruction", "response"), (Fixed("system", ("system",)), Fixed("user", ("instruction", "context")), Fixed("assistant", ("response",))), ("system", "context")),
    Layout("prompt completion", ("prompt", "completion"), (Fixed("system", ("system",)), Fixed("user", ("prompt",)), Fixed("assistant", ("completion",))), ("system",)),
    Layout("prompt response", ("prompt", "response"), (Fixed("system", ("system",)), Fixed("user", ("prompt",)), Fixed("assistant", ("response",))), ("system",)),
    Layout("question response", ("question", "response"), (Fixed("system", ("system_prompt",)), Fixed("user", ("question",)), Fixed("assistant", ("response",))), ("system_prompt",)),
    Layout("question answer", ("question", "answer"), (Fixed("system", ("system",)), Fixed("user", ("question", "context")), Fixed("assistant", ("answer",))), ("system", "context")),
    Layout("preference", ("prompt", "chosen", "rejected"), (Fixed("user", ("prompt",)), Fixed("assistant", ("chosen",)))),
    Layout("prompt messages", ("prompt[].role", "prompt[].content", "completion[].role", "completion[].content"), (Listed("prompt", "role", "content"), Listed("completion", "role", "content"))),
    Layout("history", ("query", "response", "history[][]"), (Fixed("system", ("system",)), Pairs("history", ("user", "assistant")), Fixed("user", ("query",)), Fixed("assistant", ("response",))), ("system",)),
)
KNOWN = frozenset(p for x in LAYOUTS for p in (*x.needs, *x.may))


def _nothing() -> Column:
    return F.array().cast("array<struct<role:string,text:string>>")


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _text(value: Column) -> Column:
    """The string of a variant, or the texts of its list of parts one after another."""
    parts = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")))
    return F.when(F.schema_of_variant(value).startswith("ARRAY<"), F.array_join(parts, "")).otherwise(F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("")))


_TOKEN = re.compile(r"OBJECT<|ARRAY<|>|, |(`(?:[^`]|``)*`|\w+): |[A-Z_ ]+(?:\([^)]*\))?")


def paths(schema: str) -> set[str]:
    """The nested field paths of a variant's schema; a list adds ``[]``."""
    found, stack, name = set(), [], ""
    for token in _TOKEN.finditer(schema):
        if token[1] is not None:
            name = stack[-1] + ("." if stack[-1] else "") + token[1]
        elif token[0] == "OBJECT<":
            stack.append(name)
        elif token[0] == "ARRAY<":
            stack.append(name)
            name += "[]"
        elif token[0] == ">":
            name = stack.pop()
        elif token[0] != ", ":
            found.add(name)
    return found


def fingerprint(found: set[str]) -> int:
    """A signed 64-bit hash of the paths that any layout knows; others are ignored."""
    own = "\n".join(sorted(KNOWN & found)).encode()
    return int.from_bytes(hashlib.blake2b(own, digest_size=8).digest(), "little", signed=True)


@lru_cache(4096)
def _of_schema(schema: str | None) -> int | None:
    return None if schema is None else fingerprint(paths(schema))


@F.pandas_udf(LongType())
def _fingerprints(schemas: pd.Series) -> pd.Series:
    return schemas.map(_of_schema).astype("Int64")


def _mappings() -> dict[int, tuple[str, tuple]]:
    """Name and parts by fingerprint, with each choice of the paths a layout may have."""
    out: dict[int, tuple[str, tuple]] = {}
    for x in LAYOUTS:
        for n in range(len(x.may) + 1):
            for extra in combinations(x.may, n):
                gone = set(x.may) - set(extra)
                parts = [Fixed(p.role, tuple(f for f in p.fields if f not in gone)) if isinstance(p, Fixed) else p for p in x.parts]
                own = fingerprint({*x.needs, *extra})
                if own in out:
                    raise ValueError(f"layouts {out[own][0]} and {x.name} have the same paths")
                out[own] = x.name, tuple(p for p in parts if not isinstance(p, Fixed) or p.fields)
    return out


def canonical(records: DataFrame, record: Column) -> DataFrame:
    """``records`` with ``layout`` (string) and ``turns`` (array of role, text).

    ``record`` is a VARIANT (``try_parse_json`` of JSON text, ``to_variant_object``
    of a row).  Null texts and roles are empty.  A record of no known layout, no
    JSON, or null has a null layout and no turns, and stays.
    """
    names = [c for c in records.columns if c not in ("layout", "turns")]
    found = records.select(*[f"`{c}`" for c in names], record.alias(_RECORD))
    found = found.withColumn("__mark", _fingerprints(F.schema_of_variant(_RECORD)))
    known = _mappings()
    case = lambda make: reduce(lambda c, m: F.when(F.col("__mark") == m, make(*known[m])) if c is None else c.when(F.col("__mark") == m, make(*known[m])), known, None)
    turns = case(lambda _, parts: F.concat(*[p.turns() for p in parts])).otherwise(_nothing())
    return found.select(*[f"`{c}`" for c in names], case(lambda name, _: F.lit(name)).alias("layout"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"[\\#]|(?<=<)/", r"\\$0")


def plain(text: str) -> str:
    """What ``escaped`` was made from."""
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def template(turns: DataFrame, *order: str, trained: str = TRAINED) -> DataFrame:
    """(conv_id, segment, start, formatted, loss) from turns (conv_id, role, text).

    Turns go by ``order``, then by role and text.  Segments of a conversation
    (from 0) stand one after another; ``start`` is the place of the first
    character, and ``loss`` the spans (start, end) of escaped texts of the role
    ``trained``, as code points of the whole conversation.
    """
    role = F.regexp_replace(escaped(F.coalesce("role", F.lit(""))), "\n", r"\\n")
    piece = F.concat(F.lit(HEAD), role, F.lit("\n"), escaped(F.coalesce("text", F.lit(""))), F.lit(END))
    made = turns.select("conv_id", *order, "role", "text", piece.alias("piece"), F.length(piece).cast("long").alias("n"), (F.length(role) + len(HEAD) + 1).alias("head"))
    # a conversation is sorted, never held: sums run along it
    along = W.partitionBy("conv_id").orderBy(*order, "role", "text")
    made = made.withColumns({"start": F.sum("n").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n"), "place": F.row_number().over(along)})
    span = F.struct((F.col("start") + F.col("head")).alias("start"), (F.col("start") + F.col("n") - len(END)).alias("end"))
    parts = F.sort_array(F.collect_list(F.struct("place", "piece")))
    made = made.groupBy("conv_id", F.floor(F.col("start") / SEGMENT).alias("cut")).agg(
        F.min("start").alias("start"), F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("role") == trained, span))).alias("loss"),
    )
    # numbered without gaps, whatever the length of a turn
    number = (F.row_number().over(W.partitionBy("conv_id").orderBy("cut")) - 1).alias("segment")
    return made.select("conv_id", number, "start", "formatted", "loss")


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a segment, read back."""
    out = []
    pieces = formatted.split(END)
    if pieces.pop():
        raise ValueError("text after the last turn")
    for piece in pieces:
        if not piece.startswith(HEAD):
            raise ValueError("a turn without its mark")
        role, text = piece[len(HEAD) :].split("\n", 1)
        out.append((plain(role), plain(text)))
    return out


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose segments come in order."""
    state = None

    def row() -> tuple:
        conv, turns, chars, loss, loss_chars, size = state
        return conv, turns, chars.hexdigest(), loss_chars, loss.hexdigest(), size

    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if r["segment"] == 0:
                if state:
                    done.append(row())
                state = [r["conv_id"], 0, hashlib.sha256(), hashlib.sha256(), 0, 0]
            for role, text in turns_of(r["formatted"]):
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
            for span in r["loss"]:
                text = plain(r["formatted"][span["start"] - r["start"] : span["end"] - r["start"]])
                state[3].update(text.encode())
                state[4] += len(text)
            state[5] += len(r["formatted"])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*done) if done else [()] * len(_DIGEST), _DIGEST)], schema=_DIGEST)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row(), _DIGEST)], schema=_DIGEST)


def digests(segments: DataFrame) -> DataFrame:
    """Counts and digests of conversations, read back from what ``template`` gave.

    Texts are hashed as they stream by, segment after segment, so that a
    conversation of any length needs the memory of one segment.
    """
    rows = segments.select(F.col("conv_id").cast("long").alias("conv_id"), "segment", "start", "formatted", "loss")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_chats(records: DataFrame, record: Column, *order: str) -> DataFrame:
    """Segments of the template (see ``template``) from records of any known layout.

    ``records`` has conv_id and the columns of ``order``; records of one
    conversation follow each other by these, the turns of a record as they stand
    there.  A null conv_id is a conversation of its own; nulls in ``order`` come
    first; repeated rows are turns of their own.  Records without turns, of an
    unknown layout among them, give nothing.  An empty table gives an empty result.
    """
    found = canonical(records.select("conv_id", *order, record.alias("record")), F.col("record"))
    each = found.select("conv_id", *order, F.posexplode("turns").alias("__within", "__turn"))
    return template(each.select("conv_id", *order, "__within", "__turn.role", "__turn.text"), *order, "__within")
