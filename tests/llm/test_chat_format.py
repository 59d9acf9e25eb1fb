import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from engram.llm import chat_format as cf

S, U, A = ("system", "s"), ("user", "q"), ("assistant", "a")
RECORDS = [
    ("turn rows", {"role": "user", "text": "q", "turn": 3, "id": "x"}, [U]),
    ("messages", {"id": 1, "messages": [{"role": "user", "content": "q", "weight": 1}, {"role": "assistant", "content": "a"}], "meta": {"role": 1, "text": "no"}}, [U, A]),
    ("messages", {"system": "s", "messages": [{"content": "q", "role": "user"}, {"content": None, "role": None}]}, [S, U, ("", "")]),
    ("message parts", {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}, {"type": "text", "text": "!"}]}]}, [("user", "q!")]),
    ("messages", {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": [{"type": "text", "text": "a"}]}]}, [U, A]),
    ("shared", {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "tool", "value": "7"}]}, [U, A, ("tool", "7")]),
    ("shared messages", {"conversations": [{"role": "human", "content": "q"}]}, [("human", "q")]),
    ("instruction", {"instruction": "q", "output": "a"}, [U, A]),
    ("instruction", {"instruction": "q", "input": "", "output": "a"}, [U, A]),
    ("instruction", {"instruction": "q", "input": "more", "output": "a", "system": "s"}, [S, ("user", "q\n\nmore"), A]),
    ("instruction response", {"instruction": "q", "context": "c", "response": "a", "category": "x"}, [("user", "q\n\nc"), A]),
    ("prompt completion", {"prompt": "q", "completion": "a"}, [U, A]),
    ("prompt response", {"prompt": "q", "response": None}, [U, ("assistant", "")]),
    ("question response", {"system_prompt": "s", "question": "q", "response": "a"}, [S, U, A]),
    ("question answer", {"question": "q", "answer": 42}, [U, ("assistant", "42")]),
    ("preference", {"prompt": "q", "chosen": "a", "rejected": "b"}, [U, A]),
    ("prompt messages", {"prompt": [{"role": "user", "content": "q"}], "completion": [{"role": "assistant", "content": "a"}]}, [U, A]),
    ("history", {"history": [["h", "i"], ["j", None]], "query": "q", "response": "a"}, [("user", "h"), ("assistant", "i"), ("user", "j"), ("assistant", ""), U, A]),
    (None, {"messages": []}, []),
    (None, {"title": "x"}, []),
    (None, [1, 2], []),
    (None, "text", []),
]


def test_layouts_by_their_paths(spark):
    rows = [(k, json.dumps(r)) for k, (_, r, _) in enumerate(RECORDS)] + [(100, "{broken"), (101, None), (102, "")]
    df = spark.createDataFrame(rows, "k int, json string").withColumn("layout", F.lit("clash"))
    got = {r["k"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in cf.canonical(df, F.try_parse_json("json")).collect()}
    want = {k: (name, turns) for k, (name, _, turns) in enumerate(RECORDS)} | {k: (None, []) for k in (100, 101, 102)}
    assert got == want
    assert {x.name for x in cf.LAYOUTS} == {n for n, _, _ in RECORDS} - {None}


def test_paths_of_a_schema():
    schema = "OBJECT<`a b`: BIGINT, d: DECIMAL(3,2), e: ARRAY<VOID>, m: ARRAY<ARRAY<OBJECT<`x``y`: STRING, z: OBJECT<>>>>, n: VARIANT, o: OBJECT<p: TIMESTAMP_NTZ>>"
    assert cf.paths(schema) == {"`a b`", "d", "e[]", "m[][].`x``y`", "n", "o.p"}


def by_hand(rows):
    convs = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for conv, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def test_any_text_comes_back(spark):
    """Control strings, odd characters, ties, nulls, long texts and conversations."""
    rng = random.Random(2)
    bits = ["###", "### ", "</turn>", "</turn>\n", "\\", "\\n", "\n", "<", "/", "</", "#", "user", "é", "😀", " ", "\r\n", "\\$0", "x" * 30]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, 0, 1, 2, 3]), rng.choice(["user", "assistant", "a\nb", "### x", None, "</turn>"]), "".join(rng.choices(bits, k=rng.randrange(8)))) for _ in range(200)]
    rows += [(9, 0, "user", None), (9, 1, "assistant", ""), (10, 0, "assistant", "word " * 700_000), (10, 1, "user", "#" * 10), (10, 1, "user", "#" * 10)]
    rows += [(11, k, "assistant" if k % 2 else "user", f"turn {k} " * 300) for k in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    segments = cf.format_chats(df, F.to_variant_object(F.struct("role", "text")), "turn").cache()
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in cf.digests(segments).collect()}
    assert got == by_hand(rows)
    parts = [(r["segment"], r["start"], len(r["formatted"])) for r in segments.filter("conv_id = 11").orderBy("segment").collect()]
    assert [p[0] for p in parts] == list(range(len(parts))) and len(parts) > 3
    assert all(b[1] == a[1] + a[2] for a, b in zip(parts, parts[1:])) and max(p[2] for p in parts) < cf.SEGMENT + 10_000
    for r in segments.collect():
        inner = r["formatted"].replace(cf.END, "").split(cf.HEAD)
        assert not any("</turn>" in x or "###" in x for x in inner)


def test_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cf.digests(cf.format_chats(df, F.to_variant_object(F.struct("role", "text")), "turn")).collect() == []


def test_a_damaged_output_is_noticed():
    for bad in ("### user\nx", "user\nx</turn>\n", "### user\nx</turn>\n rest"):
        with pytest.raises(ValueError):
            cf.turns_of(bad)
