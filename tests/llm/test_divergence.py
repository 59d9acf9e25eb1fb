import random
import re
from collections import Counter

import pytest

from engram.llm.source_divergence import _words, audit

COLUMNS = "doc_id long, text string, lang string, source string"


def by_hand(rows, least, top=50):
    """All rows of the audit, term by term and pair by pair."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        held = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= least)
        counts = {}
        for d in docs:
            if d[0] == lang:
                counts.setdefault(d[1], Counter()).update(t for t in d[2] if held[t] >= least)
        whole = sum(counts.values(), Counter())

        def shares(c):
            return [1 + 1_000_000_000 * (c[t] + 5) // (c.total() + 5 * len(kept)) for t in kept]

        q, p = shares(whole), {s: shares(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(sum(abs(x - y) for x, y in zip(p[s], p[o])), o) for o in counts if o != s]
            terms = [(x - y, t) for x, y, t in zip(p[s], q, kept) if counts[s][t] and x > y]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda i: (-i[0], i[1].encode()))
                out |= {(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ranked[:most])}
    return out


def found(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("share", [0.0, 0.3, 2.0])
def test_dense_and_sparse_parts_give_the_whole(spark, share):
    """All terms heavy, some, none; 150 sources need several blocks of groups."""
    rng = random.Random(3)
    vocabulary = [f"term{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)] + ["é", "ÉTÉ", "x y", "ñandú"]
    rows = []
    for k in range(1200):
        lang, source = rng.choice(["aa", "bb", None]), f"s{min(int(rng.expovariate(0.02)), 149)}"
        few = vocabulary[: 1 + int(rng.expovariate(0.05)) % len(vocabulary)]
        rows.append((k, " 7_".join(rng.choices(few, k=rng.randrange(12))), lang if k % 40 else None, source if k % 50 else None))
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    assert found(audit(df, least_docs=8, heavy_share=share)) == by_hand(rows, 8)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("doc_id", "text", "lang", "source").collect()]
    for least in (1, 2, 30):
        assert found(audit(odd_docs, least_docs=least)) == by_hand(rows, least)
    assert found(audit(no_docs)) == set()


def test_terms_of_long_texts_stay_whole():
    text = ("Añb_" * 10 + "c" * 5 + "7") * 200_000
    assert sum((Counter(w) for w in _words(text.encode())), Counter()) == {"añb".encode(): 2_000_000, b"ccccc": 200_000}
    one = "z" * 9_000_000
    assert [w for ws in _words(one.encode()) for w in ws] == [one.encode()]
