import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm.hard_negatives import best, decode, encode, mine, product

COLUMNS = "vec_id long, embedding array<float>, label int"


def by_hand(rows, step=5, positives=5, negatives=3):
    """The contract, anchor by anchor, in whole numbers of any size."""
    held = []
    for id_, vec, label in rows:
        if id_ is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        held.append((id_, label, [math.floor(float(np.float32(x)) * 256) for x in vec]))
    out = []
    for k, (a, label, x) in enumerate(held):
        if a % step:
            continue
        scores = [(sum(p * q for p, q in zip(x, y)), i, other) for n, (i, other, y) in enumerate(held) if n != k]
        order = sorted(scores, key=lambda s: (-s[0], s[1]))
        for ps, pid, _ in [s for s in order if s[2] == label][:positives]:
            fit = [s for s in order if s[2] != label and 50 * ps <= 100 * s[0] <= 95 * ps]
            out += [(a, pid, r + 1, nid, ps, ns) for r, (ns, nid, _) in enumerate(fit[:negatives])]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, COLUMNS).repartition(3).withColumns({"rid": F.lit("x"), "score": F.lit(1), "i": F.lit(0)})
    return found(mine(df, F.col("vec_id") % 5 == 0, **how))


@pytest.mark.parametrize("how", [{}, {"dims": 3, "row_block": 20, "anchor_block": 4}, {"dims": 1, "row_block": 7, "anchor_block": 2}])
def test_blocks_and_chunks_give_the_whole(spark, how):
    """One label has a third of the rows; small values, so that many scores tie."""
    rng = random.Random(5)
    rows = [(k, [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0, 0.013]) for _ in range(8)], 0 if rng.random() < 0.33 else rng.randrange(1, 30)) for k in range(240)]
    want = by_hand(rows)
    assert run(spark, rows, **how) == want and len(want) > 100


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    base = [(k, [1.0, k / 100, 0.5], k % 3) for k in range(30)]
    odd = [(5, None, 1), (10, [1.0, None, 0.0], 1), (15, [nan, 0.0, 0.0], 1), (20, [inf, 0.0, 1.0], 0), (None, [9.0, 9.0, 9.0], 1), (25, [1.0, 1.0, 1.0], None),
           (40, [1.0], 1), (45, [], 2), (50, [-1.0, -1.0, -1.0], 0), (55, [0.0, 0.0, 0.0], 1), (60, [1.0, 0.3, 0.5, 7.0], 2)]
    again = base[10:12] + base[10:11]
    assert run(spark, base + odd + again, row_block=8, anchor_block=3, dims=2) == by_hand(base + odd + again)
    assert run(spark, []) == [] and run(spark, [(5, [1.0], 1)]) == [] and run(spark, [(1, [1.0], 1)]) == []
    big = [(k, [3000.0 * (k + 1), 2500.0 - k], k % 2) for k in range(25)]
    assert run(spark, big) == by_hand(big)


def test_scores_of_any_size():
    rng = np.random.default_rng(1)
    for top in (1, 100, 30_000, 1 << 20, 1 << 40, 1 << 62):
        x = rng.integers(-top, top, (5, 7))
        assert (decode(encode(x)).reshape(5, 7) == x).all()
    a, b = rng.integers(-(1 << 28), 1 << 28, (4, 6)), rng.integers(-(1 << 28), 1 << 28, (3, 6))
    assert product(a, b).tolist() == [[sum(int(p) * int(q) for p, q in zip(x, y)) for y in b] for x in a]
    for scale in (1, 1 << 60):
        s = rng.integers(-4, 4, (20, 30)) * scale
        ok = rng.random((20, 30)) < 0.3
        ok[3] = False
        got = {(int(i), int(j)) for i, j in zip(*best(s, ok, 4))}
        assert got == {(i, j) for i in range(20) for j in sorted(np.flatnonzero(ok[i]), key=lambda j: (-s[i, j], j))[:4]}
