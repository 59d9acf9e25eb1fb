"""Hard negatives by a two-dimensional block matrix product (SUMMA-style).

Rows are sharded into blocks and their dimensions into chunks.  An anchor block
and a row block meet once a chunk and give a partial tile of int64 scores; the
partial tiles of two blocks are shuffled together and added, and only the best of
each anchor leave the sum.  A first product, over blocks that may share a label,
finds the positives of each anchor; a second, over the others, the first rows of
another label inside the score window of each (anchor, positive).

Blocks are dealt by a hash within a label (small labels are packed together), so a
label with a third of all rows is many blocks.  A task holds two chunks, or the
partial tiles of one pair of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import durable, release

#: Anchors and, about, rows of a block.
ANCHORS, ROWS = 512, 2048
#: Dimensions of a chunk, at least, and chunks at most: more dimensions make wider
#: chunks.  Wide chunks shuffle fewer partial tiles, narrow ones hold less at a time.
DIMS, MOST_CHUNKS = 32, 16
#: Components are whole multiples of 1 / SCALE, rounded down.
SCALE = 256

_PANEL = "k int, rid binary, id binary, label binary, low binary, high binary, data binary"
_TILE = "k int, a_rid binary, a_label binary, low binary, high binary, b_rid binary, b_id binary, b_label binary, tile binary"
_FOUND = "rid long, slot int, id long, score long"
_NONE = np.iinfo(np.int64).min


def encode(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold them all, byte by byte, which a
    shuffle compresses well."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    size = next(s for s in (1, 2, 4, 8) if -(1 << (8 * s - 1)) <= low and high < 1 << (8 * s - 1))
    return bytes([size]) + x.astype(f"<i{size}").reshape(-1, 1).view(np.uint8).T.tobytes()


def decode(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<i{data[0]}").ravel().astype(np.int64)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exact: in doubles where no sum can exceed 2 to the 53rd."""
    bound = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, ok: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of the first ``most`` scores of each line where ``ok``; of
    equal scores the first column."""
    lines, n = scores.shape
    most = min(most, n)
    lines_with = np.flatnonzero(ok.any(axis=1))
    scores, ok = scores[lines_with], ok[lines_with]
    if not len(lines_with) or not most:
        return lines_with[:0], lines_with[:0]
    if int(np.abs(scores).max()) < (1 << 62) // n:
        order = np.where(ok, scores * n + (n - 1 - np.arange(n)), _NONE)
        at = np.argpartition(order, n - most, axis=1)[:, n - most :]
    else:
        at = np.argsort(np.where(ok, -scores, -(_NONE + 1)), axis=1, kind="stable")[:, :most]
    line, place = np.nonzero(np.take_along_axis(ok, at, axis=1))
    return lines_with[line], at[line, place]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as lines of a matrix; missing components are 0."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width), dtype=np.int64)
    line = np.repeat(np.arange(len(sizes)), sizes)
    out[line, np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def _packed(chunks: int, wide: int):
    """A block as one row a chunk, lines in order of the id; the first row has the ids."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("rid", "ascending")])
        x = _matrix(table["x"], chunks * wide)
        flat = lambda name: table[name].to_numpy().astype("<i8").tobytes() if name in table.column_names else None
        wins = [None, None]
        if "low" in table.column_names:
            n = max((len(v) for v in table["low"].to_pylist()), default=0)
            # a missing window is one that no score is in
            fill = lambda name, gap: np.array([v + [gap] * (n - len(v)) for v in table[name].to_pylist()], dtype="<i8").tobytes()
            wins = [fill("low", 1), fill("high", 0)]
        head = [flat("rid"), flat("id"), flat("label"), *wins]
        rows = [(k, *(head if k == 0 else [None] * 5), encode(x[:, k * wide : (k + 1) * wide])) for k in range(chunks)]
        types = [pa.int32(), *[pa.binary()] * 6]
        return pa.table({n: pa.array(list(c), type=t) for n, c, t in zip(("k", "rid", "id", "label", "low", "high", "data"), zip(*rows), types)})

    return run


def _multiplied(wide: int):
    """The partial tile of an anchor block and a row block in one chunk."""
    names = [c.split()[0] for c in _TILE.split(", ")]
    types = [pa.int32(), *[pa.binary()] * 8]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = {r["side"]: r for r in table.to_pylist()}
        out = []
        if len(rows) == 2:
            a, b = rows["a"], rows["b"]
            tile = product(decode(a["data"]).reshape(-1, wide), decode(b["data"]).reshape(-1, wide))
            out = [(a["k"], a["rid"], a["label"], a["low"], a["high"], b["rid"], b["id"], b["label"], encode(tile))]
        columns = zip(*out) if out else [()] * len(names)
        return pa.table({n: pa.array(list(c), type=t) for n, c, t in zip(names, columns, types)})

    return run


def _added(most: int):
    """The partial tiles of two blocks added up, and the best of each anchor in them:
    rows of its label (slot 0), or by window those of other labels."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["k"] == 0)
        a_rid, a_label, b_rid, b_id, b_label = (np.frombuffer(head[c], dtype="<i8") for c in ("a_rid", "a_label", "b_rid", "b_id", "b_label"))
        scores = np.zeros((len(a_rid), len(b_rid)), dtype=np.int64)
        for r in rows:
            scores += decode(r["tile"]).reshape(scores.shape)
        same = a_label[:, None] == b_label
        found = []
        if head["low"] is None:
            found.append((0, *best(scores, same & (a_rid[:, None] != b_rid), most)))
        else:
            low, high = (np.frombuffer(head[c], dtype="<i8").reshape(len(a_rid), -1) for c in ("low", "high"))
            for slot in range(low.shape[1]):
                found.append((slot, *best(scores, ~same & (scores >= low[:, slot, None]) & (scores <= high[:, slot, None]), most)))
        slots = np.concatenate([np.full(len(line), slot, dtype=np.int32) for slot, line, _ in found] or [np.empty(0, np.int32)])
        line, at = (np.concatenate([f[c] for f in found] or [np.empty(0, np.int64)]).astype(np.int64) for c in (1, 2))
        return pa.table({"rid": a_rid[line], "slot": slots, "id": b_id[at], "score": scores[line, at]})

    return run


def _scored(anchors: DataFrame, rows: DataFrame, wide: int, most: int) -> DataFrame:
    """(rid, slot, id, score): the best in each pair of blocks.

    ``anchors`` and ``rows``: panels with ``i`` and ``j``, each as often as it meets
    a block of the other side.
    """
    panel = [c.split()[0] for c in _PANEL.split(", ")]
    met = anchors.select("i", "j", F.lit("a").alias("side"), *panel).unionByName(rows.select("i", "j", F.lit("b").alias("side"), *panel))
    partial = met.groupBy("i", "j", "k").applyInArrow(lambda key, t: _with_key(key, _multiplied(wide)(key, t)), "i int, j int, " + _TILE)
    return partial.groupBy("i", "j").applyInArrow(_added(most), _FOUND)


def _with_key(key: tuple, table: pa.Table) -> pa.Table:
    for n, name in enumerate(("i", "j")):
        table = table.add_column(n, name, pa.array([key[n].as_py()] * len(table), type=pa.int32()))
    return table


def _first(found: DataFrame, most: int) -> DataFrame:
    order = W.partitionBy("rid", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _blocks(rows: DataFrame, row_block: int, anchor_block: int) -> tuple[DataFrame, int, int]:
    """(label, single, j0, nj, i0, ni): the row and anchor blocks of each label, and
    how many there are of either.  A block of a ``single`` label has no other."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(F.col("anchor"), 1)).alias("na"))
    counts = durable(counts.withColumn("single", F.col("n") >= row_block), "labels")
    small = counts.filter("NOT single").agg(F.sum("n")).first()[0] or 0
    packs = max(1, -(-small // row_block))
    g = F.when(F.col("single"), F.struct(F.lit(0).alias("kind"), F.col("label").alias("of"))).otherwise(F.struct(F.lit(1).alias("kind"), F.pmod(F.xxhash64("label"), F.lit(packs)).alias("of")))
    counts = counts.withColumn("g", g)
    groups = counts.groupBy("g").agg(F.ceil(F.sum("n") / row_block).cast("int").alias("nj"), F.ceil(F.sum("na") / anchor_block).cast("int").alias("ni"))
    # as many groups as there are blocks, at most
    before = W.orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    first = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("int")
    groups = durable(groups.withColumns({"j0": first("nj"), "i0": first("ni")}), "groups")
    all_j, all_i = groups.agg(F.coalesce(F.sum("nj"), F.lit(0)), F.coalesce(F.sum("ni"), F.lit(0))).first()
    return counts.join(groups, "g").select("label", "single", "j0", "nj", "i0", "ni"), all_j, all_i


def mine(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, dims: int = DIMS, row_block: int = ROWS, anchor_block: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A component x counts as floor(256 x).  The positives of a row where ``anchor``
    holds are the first other rows of its label by inner product; each gets the
    first rows of other labels whose score is ``low`` to ``high`` per cent of the
    positive's.  Ties go to the smaller id.  Rows with a null id or label, a null
    vector, or a component that is null or not finite take no part; a short vector
    ends in zeros.  Rows count one by one, also where they repeat an id.  An empty
    table gives an empty result; further columns are ignored, whatever their names.
    """
    own = [F.col(f"`{c}`") for c in (id_col, label_col, vec_col)]
    bad = F.exists(own[2], lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = F.transform(own[2], lambda v: F.floor(v.cast("double") * SCALE))
    rows = vectors.filter(own[0].isNotNull() & own[1].isNotNull() & own[2].isNotNull() & ~bad)
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), own[0].cast("long").alias("id"), own[1].cast("long").alias("label"), whole.alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = durable(rows, "vectors")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    wide = max(dims, -(-width // MOST_CHUNKS))
    chunks = max(1, -(-width // wide))
    labels, all_j, all_i = _blocks(rows, row_block, anchor_block)
    labels = durable(labels, "blocks")

    pack = _packed(chunks, wide)
    dealt = lambda first, n: (F.col(first) + F.pmod(F.xxhash64("rid"), F.greatest(F.col(n), F.lit(1)))).cast("int")
    keyed = lambda name, cols: lambda key, t: _keyed(name, cols, key, pack(t))
    held = rows.join(labels, "label")
    spans = ["i0", "ni", "single"]
    panels = held.withColumn("j", dealt("j0", "nj")).select("j", *spans, "rid", "id", "label", "x").groupBy("j", *spans).applyInArrow(keyed("j", spans), f"j int, i0 int, ni int, single boolean, {_PANEL}")
    panels = durable(panels, "panels")
    spans_a = ["j0", "nj", "single"]
    asked = held.filter("anchor").withColumn("i", dealt("i0", "ni")).select("i", *spans_a, "rid", "id", "label", "x")
    every = lambda first, n: F.explode(F.sequence(F.col(first), F.col(first) + F.col(n) - 1))

    near = asked.groupBy("i", *spans_a).applyInArrow(keyed("i", spans_a), f"i int, j0 int, nj int, single boolean, {_PANEL}").withColumn("j", every("j0", "nj"))
    pos = _first(_scored(near, panels.filter("ni > 0").withColumn("i", every("i0", "ni")), wide, positives), positives)
    pos = durable(pos.select("rid", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # scores are whole: 100 * score lies between low and high times the positive's
    down = "(({0}) - pmod({0}, 100L)) div 100"
    ceil, floor = F.expr("-(" + down.format(f"-positive_score * {low}") + ")"), F.expr(down.format(f"positive_score * {high}"))
    window = pos.withColumns({"lo": ceil, "hi": floor}).groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("slot", "lo", "hi"))).alias("w"))
    asked = asked.join(window, "rid").select("*", F.col("w.lo").alias("low"), F.col("w.hi").alias("high")).drop("w")
    apart = lambda name, first, n: ~(F.col("single") & F.col(name).between(F.col(first), F.col(first) + F.col(n) - 1))
    far = asked.groupBy("i", *spans_a).applyInArrow(keyed("i", spans_a), f"i int, j0 int, nj int, single boolean, {_PANEL}")
    far = far.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(max(all_j - 1, 0))))).filter(apart("j", "j0", "nj"))
    others = panels.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(max(all_i - 1, 0))))).filter(apart("i", "i0", "ni"))
    neg = _first(_scored(far, others, wide, negatives), negatives)
    named = rows.filter("anchor").select("rid", F.col("id").alias("anchor_id"))
    out = neg.join(pos, ["rid", "slot"]).join(named, "rid")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _keyed(name: str, spans: list[str], key: tuple, table: pa.Table) -> pa.Table:
    """The values of the grouping key as columns before the others."""
    values = [k.as_py() for k in key]
    for n, (column, v) in enumerate(zip([name, *spans], values)):
        table = table.add_column(n, column, pa.array([v] * len(table), type=pa.bool_() if isinstance(v, bool) else pa.int32()))
    return table
