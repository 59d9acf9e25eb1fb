"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. Each partition hashes its texts and sends every owner of a hash range its
   sorted distinct fingerprints, as Golomb-Rice coded gaps.
2. An owner merges what it received and answers each sender with a bitmap of
   the fingerprints that occur more than once.
3. Only rows under a marked fingerprint are suspects; their texts are shuffled
   and compared byte for byte.

Copies inside one partition are sent once (with a bit that says so), and a text
that a batch holds several times is shuffled once, so a hot text costs a row per
batch and not one per copy.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytesets import mix
from .rows import row_hash, without
from .storage import durable, release, tables

#: Fingerprints that one owner gets, about; bounds an owner's memory and keeps the
#: messages of a block, one to each owner, few.
OWNER_ROWS = 1 << 23
#: A partition sends its fingerprints in blocks of so many rows.
BLOCK_ROWS = 1 << 17
#: The filter over marked fingerprints that is broadcast has 16 bits for each, as a
#: power of two between these: 128 KB and 64 MB.  Where that is too small, more texts
#: than the suspects are shuffled, never fewer.
FILTER_BITS = (1 << 20, 1 << 29)
#: 32-bit words of the filter that one row holds on its way to the driver.
CHUNK_WORDS = 1 << 11


#: Values, bits of the unary part, bits of a remainder.
_HEAD = struct.Struct("<IIB")


def rice_encode(values: np.ndarray) -> bytes:
    """Golomb-Rice code of the gaps of a sorted uint64 array."""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(np.log2(max(1.0, 0.7 * float(values[-1]) / len(values))))) if len(values) else 0
    quotient, rest = (gaps >> np.uint64(k)).astype(np.int64), gaps & np.uint64((1 << k) - 1)
    ends = np.cumsum(quotient + 1)
    unary = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    unary[ends - 1] = 1
    bits = ((rest[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return _HEAD.pack(len(values), len(unary), k) + np.packbits(unary).tobytes() + np.packbits(bits.ravel()).tobytes()


def rice_decode(data: bytes) -> np.ndarray:
    n, n_unary, k = _HEAD.unpack_from(data)
    raw = np.frombuffer(data, dtype=np.uint8, offset=_HEAD.size)
    unary_bytes = (n_unary + 7) // 8
    ends = np.flatnonzero(np.unpackbits(raw[:unary_bytes], count=n_unary))
    quotient = np.diff(ends, prepend=-1) - 1
    bits = np.unpackbits(raw[unary_bytes:], count=n * k).reshape(n, k).astype(np.uint64)
    rest = (bits << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64) if k else np.zeros(n, np.uint64)
    return np.cumsum((quotient.astype(np.uint64) << np.uint64(k)) + rest, dtype=np.uint64)


def _fingerprint(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    column = batch.column(batch.schema.get_field_index(name))
    # bytes.lower() changes A-Z only, which UTF-8 never uses inside other characters
    return [(t or b"").lower() for t in column.cast(pa.binary()).to_pylist()]


def _messages(owners: int, shift: int):
    """Rows (block, owner, code, repeated) of a partition."""
    schema = pa.schema([("block", pa.string()), ("owner", pa.int32()), ("code", pa.binary()), ("repeated", pa.binary())])
    # an owner has a range of the top 24 bits
    starts = np.array([-(-o * (1 << 24) // owners) << 40 for o in range(owners)], dtype=np.uint64)

    def flush(block: str, prints: list) -> pa.RecordBatch:
        distinct, count = np.unique(np.array(prints, dtype=np.uint64), return_counts=True)
        # sorted once: each owner's share is a slice
        cuts = np.append(np.searchsorted(distinct, starts), len(distinct))
        rows = []
        for o in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[o], cuts[o + 1])
            rows.append((block, int(o), rice_encode((distinct[own] >> np.uint64(shift)) - (starts[o] >> np.uint64(shift))), np.packbits(count[own] > 1).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        prints: list = []
        for batch in batches:
            prints += [_fingerprint(t) for t in _texts(batch, "text")]
            if len(prints) >= BLOCK_ROWS:
                yield flush(f"{part}:{k}", prints)
                prints, k = [], k + 1
        if prints:
            yield flush(f"{part}:{k}", prints)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """An owner's work: decode, find what occurs twice, answer with bitmaps.

    Values within a message are distinct and rising, also once shifted together
    where two fingerprints differ in dropped bits only: those count as one twice.
    """
    sent = [rice_decode(c) for c in table.column("code").to_pylist()]
    every = np.sort(np.concatenate(sent))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    marks = []
    for own, repeated in zip(sent, table.column("repeated").to_pylist()):
        at = np.minimum(np.searchsorted(twice, own), max(len(twice) - 1, 0))
        met = twice[at] == own if len(twice) else np.zeros(len(own), dtype=bool)
        marks.append((np.packbits(met) | np.frombuffer(repeated, dtype=np.uint8)).tobytes())
    return pa.table({"block": table.column("block"), "owner": table.column("owner"), "marks": pa.array(marks, type=pa.binary())})


def _marked(owners: int, shift: int, size: int):
    """The filter's words with the bits that a batch's bitmaps set in them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty(0, dtype=np.int64)]
            for owner, code, marks in zip(*(batch.column(n).to_pylist() for n in ("owner", "code", "marks"))):
                own = rice_decode(code)
                own = own[np.unpackbits(np.frombuffer(marks, dtype=np.uint8), count=len(own)).astype(bool)]
                found.append(_filter_places(own + np.uint64((-(-owner * (1 << 24) // owners) << 40) >> shift), size))
            places = np.unique(np.concatenate(found))
            words, begin = np.unique(places >> 5, return_index=True)
            bits = np.bitwise_or.reduceat(np.int64(1) << (places & 31), begin) if len(words) else words
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int32)), pa.array(bits)], names=["word", "bits"])

    return run


def _filter_places(values: np.ndarray, size: int) -> np.ndarray:
    return (mix(values, 31) & np.uint64(size - 1)).astype(np.int64)


def _chunk(table: pa.Table) -> pa.Table:
    """CHUNK_WORDS words of the filter as one value."""
    words = table.column("word").to_numpy()
    out = np.zeros(CHUNK_WORDS, dtype="<u4")
    out[words % CHUNK_WORDS] = table.column("bits").to_numpy().astype(np.uint32)
    return pa.table({"chunk": pa.array([int(words[0]) // CHUNK_WORDS], type=pa.int64()), "bits": pa.array([out.tobytes()], type=pa.binary())})


def _filter(messages: DataFrame, owners: int, shift: int) -> np.ndarray:
    """The broadcast filter, from the exchange of messages and bitmaps."""
    answers = messages.groupBy("owner").applyInArrow(_answer, "block string, owner int, marks binary")
    told = durable(messages.select("block", "owner", "code").join(answers, ["block", "owner"]), "told")
    # a hexadecimal digit that isn't zero marks four fingerprints at most
    marked = 4 * (told.agg(F.sum(F.length(F.translate(F.hex("marks"), "0", "")))).first()[0] or 0)
    size = FILTER_BITS[0]
    while size < min(FILTER_BITS[1], 16 * marked):
        size *= 2
    words = told.mapInArrow(_marked(owners, shift, size), "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    # at most size / 32 words, packed before they reach the driver
    rows = words.groupBy(F.expr(f"word div {CHUNK_WORDS}")).applyInArrow(_chunk, "chunk long, bits binary").toArrow()
    release(told)
    table = np.zeros((size // 32 // CHUNK_WORDS, CHUNK_WORDS), dtype=np.uint32)
    for chunk, bits in zip(rows.column("chunk").to_pylist(), rows.column("bits").to_pylist()):
        table[chunk] = np.frombuffer(bits, dtype="<u4")
    return table.ravel()


def _suspects(shared, shift: int):
    """Rows (ids, rows, sha, norm) of a batch: norm is null for a text that is no
    suspect; a suspect text stands once, with all its ids."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("sha", pa.string()), ("norm", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        for batch in batches:
            texts = _texts(batch, "text")
            prints = np.fromiter((_fingerprint(t) for t in texts), dtype=np.uint64, count=len(texts))
            at = _filter_places(prints >> np.uint64(shift), 32 * len(seen))
            hit = (seen[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1)
            alone, groups = [], {}
            for id_, row, text, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, hit.tolist()):
                if h:
                    own = groups.setdefault(text, ([], []))
                    own[0].append(id_)
                    own[1].append(row)
                else:
                    alone.append(([id_], [row], hashlib.sha256(text).hexdigest(), None))
            rows = alone + [(ids, own, hashlib.sha256(text).hexdigest(), text) for text, (ids, own) in groups.items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _judged(docs: DataFrame, id_col: str, text_col: str, owner_rows: int) -> DataFrame:
    """(doc_id, row, keep_id, group_size, text_sha256) for every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_hash(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    total = max(1, docs.count())
    owners = min(1 << 20, max(4, -(-total // owner_rows)))
    # fingerprints keep log2(rows) + 12 bits: few false suspects, short codes
    shift = 64 - min(64, int(np.ceil(np.log2(total))) + 12)
    messages = durable(rows.select("text").mapInArrow(_messages(owners, shift), "block string, owner int, code binary, repeated binary"), "messages")
    shared = spark.sparkContext.broadcast(_filter(messages, owners, shift))
    release(messages)
    told = durable(rows.mapInArrow(_suspects(shared, shift), "ids array<long>, rows array<long>, sha string, norm binary"), "judged")
    doubtful = told.filter("norm IS NOT NULL")
    groups = doubtful.groupBy("norm", "sha").agg(F.max(F.array_max("ids")).alias("keep_id"), F.sum(F.size("ids")).cast("long").alias("group_size"))
    groups = durable(groups, "groups")
    same = (F.col("d.sha") == F.col("g.sha")) & (F.col("d.norm") == F.col("g.norm"))
    each = lambda df: df.select(F.explode(F.arrays_zip("ids", "rows")).alias("x"), "keep_id", "group_size", "sha")
    members = each(doubtful.alias("d").join(groups.alias("g"), same).select("d.ids", "d.rows", "g.keep_id", "g.group_size", "d.sha"))
    alone = each(told.filter("norm IS NULL").select("ids", "rows", F.col("ids")[0].alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha"))
    return members.unionByName(alone).select(F.col("x.ids").alias("doc_id"), F.col("x.rows").alias("row"), "keep_id", "group_size", F.col("sha").alias("text_sha256"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_rows: int = OWNER_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty.  The largest id of a group stays.  Rows that repeat both an id and
    its text are counted each; they share one ``kept`` value.  An empty table
    gives an empty result; other columns are ignored, whatever their names.
    """
    judged = _judged(docs, id_col, text_col, owner_rows)
    return judged.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each text, with all their columns.

    A row goes or stays by its own id and text: another row with its id is no
    concern.  Of several rows with the largest id (or without any) one stays.
    """
    with tables() as keep:
        copied = durable(_judged(docs, id_col, text_col, OWNER_ROWS).filter("group_size > 1").select("doc_id", "row", "keep_id", "text_sha256"), "copied")
        first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
        gone = copied.filter(~first).select("row", F.lit(False).alias("once")).distinct()
        # the rows under the largest id: one in most groups, which needs no verdict
        each = copied.filter(first).groupBy("text_sha256", "row").agg(F.count("*").alias("k"))
        each = each.withColumn("once", F.col("row") == F.min("row").over(W.partitionBy("text_sha256"))).filter("NOT once OR k > 1")
        verdicts = keep(durable(gone.unionByName(each.select("row", "once")), "verdicts"))
    return without(docs, row_hash(id_col, text_col), verdicts)
