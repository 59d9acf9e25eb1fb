"""Batch engines: plans over the stores, each timed and isolated."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_negation, tokens
from ..storage import durable


#: Counters of the sketch by which words are put in order: it bears on speed alone.
BUCKETS = 1 << 18
#: Share of the words in common of which candidates must have one word more in their first
#: words, and sets that are put in order at a time: they bear on speed and memory alone.
PART, AT_ONCE = 0.03, 1024


def _counted(batches):
    """How often words of each bucket stand in texts with a negation, and in others."""
    counts = np.zeros(2 * BUCKETS, dtype=np.int64)
    for batch in batches:
        w = batch.column(0)
        side = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), w.value_lengths().to_numpy())
        counts += np.bincount((w.flatten().to_numpy() & BUCKETS - 1) * 2 + side, minlength=2 * BUCKETS)
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], names=["bucket", "n"])


def _prefixes(cost, overlap: float):
    """The words of each set that a contradicting one may share first, with their places.

    Words are in order of how many pairs they would make, by the sketch, then of their
    own value; those that stand on one side only make none, and go once places are given.
    """

    def run(batches):
        for batch in (b.slice(at, AT_ONCE) for b in batches for at in range(0, b.num_rows, AT_ONCE)):
            w = batch.column(1)
            n = w.value_lengths().to_numpy().astype(np.int64)
            line, words = np.repeat(np.arange(len(n)), n), w.flatten().to_numpy()
            dear = cost.value[words & BUCKETS - 1]
            order = np.lexsort((words, dear, line))
            place = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n) + 1
            kept = (place <= np.repeat(n - np.ceil((1 - PART) * overlap * n - 1e-6).astype(np.int64) + 1, n)) & (dear[order] > 0)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(line[kept], minlength=len(n)))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (words[order][kept], place[kept].astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int32)), batch.column(2), *lists], names=["id", "n", "neg", "words", "places"])

    return run


def contradiction_classes(docs: DataFrame, overlap: float = 0.5, text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """(a, b, jaccard) of texts that share words but differ in negation, and (id, rep).

    Texts of equal word sets are one class, known by its least id: pairs are of
    classes, and every text with words stands in the second frame with its class, so
    copies are never expanded into pairs.  Exact for any corpus size: two sets with
    Jaccard similarity t or more share a part p of what they must share, and one word more,
    among each set's first n - ceil((1 - p) t n) + 1 words in any one order, so candidates
    come from an equi-join on those words.  The order comes from a sketch of fixed size,
    so a set finds its first words by itself.
    """
    spark = docs.sparkSession
    # no filter before the table is written: it would look for all words again
    t = docs.select("id", tokens(F.col(text_col)).alias("own"))
    t = t.select("id", F.array_sort(F.transform("own", lambda w: F.xxhash64(w))).alias("w"), has_negation(F.col("own")).alias("neg"))
    t = durable(t, "sets").filter(F.size("w") > 0)
    counts = t.select("w", "neg").mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    both = np.zeros(2 * BUCKETS, dtype=np.float64)
    both[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    cost = spark.sparkContext.broadcast(both[::2] * both[1::2])
    # a class is known by the hash of its words
    known = t.select("id", F.struct(F.xxhash64("w"), F.size("w"), "neg").alias("cls"))
    reps = durable(known.groupBy("cls").agg(F.min("id").alias("rep")), "classes")
    kind = docs.schema["id"].dataType.simpleString()
    first = t.select("id", "w", "neg").mapInArrow(_prefixes(cost, overlap), f"id {kind}, n int, neg boolean, words array<bigint>, places array<int>")
    first = first.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "n", "neg", F.explode(F.arrays_zip("words", "places")).alias("p"))
    x = first.filter("neg").select("p.words", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("p.places").alias("rx"))
    y = first.filter("NOT neg").select("p.words", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("p.places").alias("ry"))
    # of a pair that shares ``least`` words, the first ``PART`` of these, and one more, have the
    # rest of them behind
    least = overlap / (1 + overlap) * (F.col("nx") + F.col("ny")) - 1e-9
    early = F.least(F.col("nx") - F.col("rx"), F.col("ny") - F.col("ry")) + 1 >= (1 - PART) * least
    met = x.join(y, "words").filter((F.least("nx", "ny") >= overlap * F.greatest("nx", "ny")) & early)
    met = met.groupBy("x", "y", "nx", "ny").agg(F.count("*").alias("shared")).filter(F.col("shared") >= F.floor(PART * least) + 1)
    pairs = durable(met.select("x", "y"), "pairs")

    def side(own: DataFrame, name: str, w: str) -> DataFrame:
        # few sets have a candidate: only these move
        asked = pairs.select(F.col(name).alias("id")).distinct()
        return own.join(asked, "id", "left_semi").select(F.col("id").alias(name), F.col("w").alias(w))

    scored = pairs.join(side(t.filter("neg"), "x", "w1"), "x").join(side(t.filter("NOT neg"), "y", "w2"), "y")
    common = F.size(F.array_intersect("w1", "w2"))
    scored = scored.select("x", "y", (common / (F.size("w1") + F.size("w2") - common)).alias("jaccard"))
    scored = scored.filter(F.col("jaccard") >= overlap)
    members = known.join(reps, "cls").select("id", "rep")
    return scored.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard"), members


def contradictions(docs: DataFrame, overlap: float = 0.5, text_col: str = "content") -> DataFrame:
    """(a, b, jaccard) of all texts: the classes' pairs with each class's texts."""
    pairs, members = contradiction_classes(docs, overlap, text_col)
    of = lambda name, rep: members.select(F.col("id").alias(name), F.col("rep").alias(rep))
    out = pairs.join(of("p", "a"), "a").join(of("q", "b"), "b")
    return out.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "jaccard")


def collapse_duplicates(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, kept_by): records that a more important, then newer, duplicate beats.

    ``pairs``: a, b with similarity above the threshold.
    """
    info = docs.select("id", F.struct("importance", "created_at", "id").alias("k"))
    p = pairs.join(info.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(info.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    beats = p.select(F.when(F.col("ka") < F.col("kb"), F.col("a")).otherwise(F.col("b")).alias("id"), F.greatest("ka", "kb").alias("k"))
    return beats.groupBy("id").agg(F.max("k").alias("k")).select("id", F.col("k.id").alias("kept_by"))


def fold_duplicates(pairs: list[tuple[str, str]], order: dict[str, tuple[float, float]]) -> list[str]:
    """The order-dependent pass over a bounded scan: ``pairs`` by place of a, then b.

    A record that lost is no longer compared as b, nor starts a round as a; the
    one that loses during its own round ends it as it was.
    """
    removed: list[str] = []
    gone: set[str] = set()
    current, active = None, False
    for a, b in pairs:
        if a != current:
            current, active = a, a not in gone
        if not active or b in gone:
            continue
        loser = a if order[a] <= order[b] else b
        if loser not in gone:
            gone.add(loser)
            removed.append(loser)
    return removed


class Engine:
    """A batch job: ``plan`` builds frames, ``run`` times it and keeps errors in."""

    name = "engine"

    def __init__(self, plan: Callable[..., dict[str, DataFrame]], name: str):
        self.plan, self.name = plan, name

    def run(self, **stores: DataFrame) -> dict[str, Any]:
        began = time.time()
        try:
            made = self.plan(**stores)
            result = {k: v.count() for k, v in made.items()}
            return {"engine": self.name, "ok": True, "stats": result, "error": None, "duration_ms": 1000 * (time.time() - began)}
        except Exception as error:  # an engine's failure is its result
            return {"engine": self.name, "ok": False, "stats": {}, "error": str(error), "duration_ms": 1000 * (time.time() - began)}
