import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from engram.llm.best_fit_packing import pack, plan
from engram.llm.quality_rules import keep_good, quality_rules
from engram.llm.source_mixing import mix, repeat_rows
from engram.llm.token_ids import TextTokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_rules_on_odd_rows(odd_docs, no_docs):
    got = {r["doc_id"]: r for r in quality_rules(odd_docs).collect()}
    assert got[4]["n_words"] == got[5]["n_words"] == got[6]["n_words"] == 0 and not got[4]["kept"]
    assert got[9]["n_repeat_words"] == got[9]["n_words"] == 9000 and got[9]["base_failed"]
    assert got[1]["n_words"] == 80 and got[1]["n_repeat_words"] == 0
    assert quality_rules(no_docs).count() == 0
    assert keep_good(odd_docs).columns == odd_docs.columns


def test_repeat_words_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcd", k=n)) for n in (0, 1, 2, 3, 4, 9, 30, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules(df).collect():
        w = texts[r["doc_id"]].split()
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
        assert r["n_repeat_words"] == len(hit)


def test_token_ids_equal_the_tokenizer():
    full, own = Tokenizer.from_file(str(PATH)), TextTokens(str(PATH))
    texts = ["Hello, World! it's a..b x,,y", "", " \n\t ", "l’été ñandú Straße", "İstanbul ΑΣ 12.5% #tag <|endoftext|>", "é a b c", "日本語 テスト", "\x1c a\x85b"]
    for t in texts:
        assert own.ids(t) == np.array(full.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes(), t


def test_plan_is_whole_and_tight():
    rng = random.Random(1)
    for capacity in (10, 64, 4096):
        counts = {k: rng.randrange(0, 50) for k in range(1, capacity + 1, max(1, capacity // 97))} | {capacity: 3}
        places, n = plan(counts, capacity)
        fill, seen = {}, {k: 0 for k in counts}
        for p, q in zip(places, places[1:] + [None]):
            end = counts[p.length] if q is None or q.length != p.length else q.rank
            for r in range(p.rank, end):
                s = p.sequence + (r - p.rank) // p.times
                fill[s] = fill.get(s, 0) + p.length
                seen[p.length] += 1
        total = sum(k * v for k, v in counts.items())
        assert seen == counts and max(fill.values()) <= capacity and len(fill) == n
        # no plan has fewer sequences than this: two pieces over half never share one
        least = max(-(-total // capacity), sum(v for k, v in counts.items() if 2 * k > capacity))
        assert n <= least * 1.05 + 1


def test_pack_is_an_exact_round_trip(spark, odd_docs, no_docs):
    full = Tokenizer.from_file(str(PATH))
    docs = odd_docs.unionByName(odd_docs.limit(1).withColumn("text", F.repeat(F.lit("hello world "), 6000)).withColumn("doc_id", F.lit(99).cast("long")))
    rows = pack(docs, str(PATH)).collect()
    ids = {}
    for d in docs.collect():
        ids.setdefault(d["doc_id"], []).append(np.array(full.encode(d["text"] or "", add_special_tokens=False).ids + [1], dtype="<u4"))
    for r in rows:
        part = ids[r["doc_id"]][0][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["length"] == len(part) and r["start"] == 4096 * r["piece"]
    assert sum(r["length"] for r in rows) == sum(len(x) for v in ids.values() for x in v)
    by = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == by.get(r["sequence_id"], 0)
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 4096
    assert pack(no_docs, str(PATH)).count() == 0


def targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, done = dict.fromkeys(names), {}
    total = sum(sizes.values())
    while True:
        free = [s for s in left if s not in done]
        share = (total - sum(done.values())) / max(1, sum(w[s] for s in free))
        over = [s for s in free if share * w[s] > most * sizes[s] + 1e-9]
        if not over:
            return done | {s: share * w[s] for s in free}
        done |= {s: float(most * sizes[s]) for s in over}


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["w"] * rng.choice([1, 3, 10, 50, 200])), rng.choice(["a", "a", "a", "b", "c", "d", None])) for k in range(600)] + [(600, "x y", "tiny"), (601, None, "zero")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a, b = mix(df).toPandas(), mix(df.repartition(7)).toPandas()
    assert a.sort_values("doc_id").reset_index(drop=True).equals(b.sort_values("doc_id").reset_index(drop=True))
    a["source"] = a.doc_id.map({d: s for d, _, s in rows})
    sizes = {}
    for d, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    assert (a.taken <= 3 * a["size"]).all()
    for s, g in a.groupby("source", dropna=False):
        s = None if s != s or s is None else s
        assert g.target.iloc[0] == pytest.approx(want[s]) and g.source_size.iloc[0] == sizes[s]
        assert abs(g.taken.sum() - want[s]) <= 2
    assert repeat_rows(df).count() == a[a["size"] > 0].eval("taken / size").sum()


def test_rows_are_repeated_as_dealt(spark):
    """Row by row what ``mix`` deals, with rows that repeat, null ids and one id for all."""
    rng = random.Random(4)
    texts = [" ".join(["w"] * n) for n in (1, 1, 2, 5, 40)]
    rows = [(rng.choice([None, 1, 2, k]), rng.choice(texts), rng.choice(["a", "a", "b", None])) for k in range(300)] + [(7, texts[2], "b")] * 50 + [(8, None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    # ids repeat, so what is dealt is summed over an id, a source and a size
    sized = df.select("doc_id", "source", F.coalesce(F.size(F.split("text", " ")), F.lit(0)).alias("n"))
    want = mix(df).groupBy("doc_id", "size", "source_size").agg(F.sum("copies").alias("k")).filter("k > 0")
    whole = sized.groupBy("source").agg(F.sum(F.when(F.col("n") > 0, F.col("n")).otherwise(0)).alias("source_size"))
    got = repeat_rows(df).select("doc_id", "source", F.size(F.split("text", " ")).alias("size")).groupBy("doc_id", "source", "size").count()
    got = got.join(whole, got["source"].eqNullSafe(whole["source"])).select("doc_id", "size", "source_size", "count")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.select("doc_id", "size", "source_size", "k").collect()), key=str)


def test_mix_on_odd_rows(odd_docs, no_docs):
    assert mix(odd_docs).count() == odd_docs.count()
    assert mix(no_docs).count() == 0
    assert repeat_rows(odd_docs).columns == odd_docs.columns
