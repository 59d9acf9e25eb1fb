import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engram.llm import ngram_jaccard_join as join
from engram.llm.bytesets import shingle_sets
from engram.llm.components import components
from engram.llm.exact_dedup import drop_copies, exact_groups, rice_decode, rice_encode


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**52), max_size=60))
def test_rice_round_trip(values):
    v = np.array(sorted(values), dtype=np.uint64)
    assert (rice_decode(rice_encode(v)) == v).all()


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_groups_on_odd_rows(spark, odd_docs):
    rows = odd_docs.collect()
    got = sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"]) for r in exact_groups(odd_docs).collect())
    want = []
    for r in rows:
        same = [x["doc_id"] for x in rows if low(x["text"]) == low(r["text"])]
        keep = max((i for i in same if i is not None), default=None)
        want.append((r["doc_id"] or -1, keep or -1, len(same), r["doc_id"] == keep))
    assert got == sorted(want)
    kept = {r["doc_id"] for r in drop_copies(odd_docs).collect()}
    assert 1 not in kept and 2 in kept and drop_copies(odd_docs).columns == odd_docs.columns


def test_exact_groups_with_many_owners(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = exact_groups(d), exact_groups(d, owner_rows=16)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_rows_go_by_id_and_text(spark):
    rows = [(5, "copied text"), (9, "copied text"), (5, "only here"), (7, "same row"), (7, "same row"), (None, "no id"), (None, "No Id"), (1, ""), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r[0], low(r[1])) for r in drop_copies(df).collect()), key=str)
    assert kept == sorted([(9, "copied text"), (5, "only here"), (7, "same row"), (None, "no id"), (2, "")], key=str)
    long_ = " ".join(f"w{k}" for k in range(60))
    rows = [(4, long_), (4, long_ + " x"), (8, long_ + " y"), (4, "another text under this id, not like it"), (6, "one one"), (6, "one one"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r[0], r[1][:7]) for r in join.one_of_each(df).collect())
    assert kept == [(3, ""), (4, "another"), (4, "w0 w1 w"), (6, "one one")]


def components_by_hand(rows):
    """Least id of each row's component, by all pairs of rows."""
    sets = []
    for _, text in rows:
        w = low(text).split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least.setdefault(find(k), []).append(i)
    return [(i, len(s), min((x for x in least[find(k)] if x is not None), default=None) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def test_rows_without_ids_link_by_their_texts(spark):
    """Null and repeated ids; copies that only rows without an id hold."""
    rng = random.Random(6)
    base = [" ".join(f"v{rng.randrange(4000)}" for _ in range(60)) for _ in range(12)]
    rows = []
    for k in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((rng.choice([None, None, rng.randrange(40)]), " ".join(words)))
    rows += [(None, base[0] + " tail"), (None, "few words"), (None, "few words"), (None, None), (3, "few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in join.near_components(df).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == sorted(components_by_hand(rows), key=str)
    alone = [(None, base[0]), (None, base[0] + " tail"), (5, base[1]), (6, base[1] + " tail")]
    kept = join.one_of_each(spark.createDataFrame(alone, "doc_id long, text string")).collect()
    assert sorted((r[0] for r in kept), key=str) == [5, None]


def test_a_passage_that_unlinked_texts_share(spark):
    """Hundreds of texts of all lengths with one passage; near copies of a few among them."""
    rng = random.Random(7)
    passage = " ".join(f"p{k}" for k in range(50))
    own = [" ".join(f"o{k}_{j}" for j in range(rng.randrange(2, 160))) for k in range(250)]
    rows = [(k, f"{passage} {o}") for k, o in enumerate(own)] + [(1000 + k, f"{passage} {own[k]} end") for k in range(0, 250, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [tuple(r) for r in join.near_components(df).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got) == sorted(components_by_hand(rows))


def test_messages_and_answers_against_brute_force():
    from engram.llm import exact_dedup as ed

    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2)
    blocks = [rng.choice(pool, 150) for _ in range(4)]
    for owners, shift in ((1, 0), (7, 20), (4, 52)):
        starts = [-(-o * (1 << 24) // owners) << 40 for o in range(owners)]
        count = Counter(int(x) >> shift for b in blocks for x in b)
        for o in range(owners):
            end = starts[o + 1] if o + 1 < owners else 1 << 64
            sent = []
            for k, b in enumerate(blocks):
                d, c = np.unique(b[[starts[o] <= int(x) < end for x in b]], return_counts=True)
                sent.append((f"{k}", o, ed.rice_encode((d >> np.uint64(shift)) - np.uint64(starts[o] >> shift)), np.packbits(c > 1).tobytes(), d))
            table = pa.table({"block": [x[0] for x in sent], "owner": [o] * 4, "code": [x[2] for x in sent], "repeated": [x[3] for x in sent]})
            for x, marks in zip(sent, ed._answer(table).column("marks").to_pylist()):
                flags = np.unpackbits(np.frombuffer(marks, dtype=np.uint8), count=len(x[4])).astype(bool)
                assert flags.tolist() == [count[int(v) >> shift] > 1 for v in x[4]]


def test_empty_tables(no_docs):
    assert exact_groups(no_docs).count() == 0
    assert join.near_components(no_docs).count() == 0


def words(t):
    return re.findall(r"[^\x20\x09-\x0d]+", low(t))


def shingles(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs, in_order=False):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    ids = {}
    for k, (d, _) in enumerate(docs):
        ids[root(k)] = min(ids.get(root(k), d), d)
    out = [(d, len(s), ids[root(k)]) for k, ((d, _), s) in enumerate(zip(docs, sets))]
    return out if in_order else set(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocab, k=30)
    docs, n = [], 0
    for group in range(12):
        base = rng.choices(vocab, k=rng.choice([3, 8, 40, 120]))
        for _ in range(rng.choice([1, 2, 9])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            docs.append((n, " ".join(own + (passage if group % 3 == 0 else []))))
            n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, "  \t")]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in join.near_components(df).collect()}
    assert got == brute(docs)


def test_odd_rows(odd_docs):
    got = sorted((r["doc_id"] or -1, r["n_shingles"]) for r in join.near_components(odd_docs).collect())
    assert got == sorted((r["doc_id"] or -1, len(shingles(r["text"]))) for r in odd_docs.collect())
    assert join.one_of_each(odd_docs).columns == odd_docs.columns


def test_filters_lose_no_link():
    rng = random.Random(5)
    for _ in range(200):
        a = [str(rng.randrange(10**9)) for _ in range(rng.choice([1, 2, 5, 60, 300]))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            b[rng.randrange(len(b))] = str(rng.randrange(10**9))
        p, q = shingle_sets([" ".join(a).encode(), " ".join(b).encode()])
        both = len(np.intersect1d(p, q))
        if 100 * both >= 75 * (len(p) + len(q) - both):
            assert join.bitmaps_allow(len(p), len(q), join._bitmap(p), join._bitmap(q))
            for salt in (12, 13):
                assert join.prefixes_meet(join._hash_prefix(p, salt), join._hash_prefix(q, salt))


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (105, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(61)) and got[105] == 100 and len(got) == 64
