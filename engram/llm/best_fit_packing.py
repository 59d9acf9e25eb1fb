"""Best-fit packing by minimum bin slack.

Texts become token pieces of at most ``capacity``; only longer documents are
cut.  Which lengths share a sequence is decided on the table of lengths alone
(at most ``capacity`` counts, whatever the corpus): per sequence the longest
length left is placed and a bitset subset-sum over the remaining lengths finds
the fullest combination with it; the combination is taken out as often as the
counts allow.  Pieces then find their place by their rank among the pieces of
their length, so no task and no driver sees more than a partition of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import durable

CAPACITY = 4096
#: Pieces of one length that are ranked together, about, and the least number of parts.
PART_ROWS, LEAST_PARTS = 1 << 18, 64
END_ID = 1

_TOKENS: dict[str, object] = {}


class Place(NamedTuple):
    """Pieces of ``length`` with rank >= ``rank`` go to sequences from
    ``sequence`` on, ``times`` to each, from ``offset`` on."""

    length: int
    rank: int
    times: int
    sequence: int
    offset: int


def _fullest(items: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """The (length, times) whose sum is largest within ``room``.

    ``items``: (length, count) by falling length.  ``sums`` has bit s set when s
    is reachable; each binary part of a count is one shift and or.
    """
    sums, steps, limit = 1, [], (1 << (room + 1)) - 1
    for length, count in items:
        if length > room:
            continue
        left, part = min(count, room // length), 1
        while left:
            take = min(part, left)
            steps.append((length, take, sums))
            sums |= (sums << (length * take)) & limit
            left -= take
            part *= 2
        if sums >> room & 1:
            break
    at, chosen = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return list(chosen.items())


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Place], int]:
    """Places for all pieces of a table of lengths, and the number of sequences."""
    left = {k: v for k, v in counts.items() if v}
    used = dict.fromkeys(left, 0)
    places, sequence = [], 0
    lengths = sorted(left, reverse=True)
    while lengths:
        longest = lengths[0]
        left[longest] -= 1
        combo = dict(_fullest([(k, left[k]) for k in lengths if left[k]], capacity - longest))
        left[longest] += 1
        combo[longest] = combo.get(longest, 0) + 1
        repeat = min(left[k] // m for k, m in combo.items())
        offset = 0
        for k in sorted(combo, reverse=True):
            m = combo[k]
            places.append(Place(k, used[k], m, sequence, offset))
            offset += k * m
            used[k] += m * repeat
            left[k] -= m * repeat
        sequence += repeat
        lengths = [k for k in lengths if left[k]]
    return sorted(places), sequence


def _pieces(tokenizer_path: str, capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .token_ids import TextTokens

        if tokenizer_path not in _TOKENS:
            _TOKENS[tokenizer_path] = TextTokens(tokenizer_path)
        ids, end, step = _TOKENS[tokenizer_path].ids, END_ID.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = ids(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone.  Rows that repeat a document are
    packed each.  An empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = durable(rows.mapInArrow(_pieces(tokenizer_path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    spread = max(LEAST_PARTS, pieces.count() // PART_ROWS)
    pieces = pieces.withColumn("b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(spread)).cast("int"))
    parts = pieces.groupBy("length", "b").agg(F.count("*").alias("k"))
    before = W.partitionBy("length").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    ahead = parts.select("length", "b", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("ahead"))
    # the table of lengths: at most ``capacity`` rows
    table = parts.groupBy("length").agg(F.sum("k").alias("k")).toArrow()
    places, _ = plan(dict(zip(table.column("length").to_pylist(), table.column("k").to_pylist())), capacity)
    # bounded by the number of lengths: at most a few entries for each
    shared = docs.sparkSession.sparkContext.broadcast(np.array(places, dtype=np.int64).reshape(-1, 5))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        keys = at[:, 0] << np.int64(44) | at[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            own = at[np.searchsorted(keys, length << np.int64(44) | rank, side="right") - 1]
            nth = rank - own[:, 1]
            sequence, offset = own[:, 3] + nth // own[:, 2], own[:, 4] + nth % own[:, 2] * length
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    own = F.row_number().over(W.partitionBy("length", "b").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("r", own).join(ahead, ["length", "b"]).withColumn("rank", F.col("ahead") + F.col("r") - 1).drop("r", "ahead", "b")
    return ranked.mapInArrow(settle, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
