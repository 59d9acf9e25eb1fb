"""N-gram Jaccard join by filters under several global token orders.

A document is the set of its five-word shingles, known by 64-bit hashes; equal
sets are one class.  Two sets with Jaccard similarity of 3/4 or more share a
token among the first n - ceil(3n/4) + 1 of each, under any global order.

* Order 1 is rarest first, by a count sketch over the corpus.  Its prefixes are
  exchanged, and tokens that only one class holds are dropped there; what is
  left gives candidate pairs.
* A candidate's lengths, the places of the shared token and bitmaps of the two
  sets must allow the overlap.
* Orders 2 and 3 are hash orders.  A candidate stays only if the prefixes also
  meet under both.
* Candidates that pass are verified on the whole sets.

Components, not all pairs, are asked for.  Sparse rounds first link each class
to a few others with which it shares a token; the last round takes every pair
that shares a token and is still in different components.  So no link between
components is missed, and a group of near copies is not expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytesets import mix, parts, shingle_sets
from .components import components
from .rows import row_hash, without
from .storage import durable, release, tables

_U = np.uint64
#: Counters of the sketch that orders tokens by frequency.
SKETCH_BITS = 17
#: Prefix entries that one owner of a token range gets, about.
OWNER_ROWS = 1 << 20
#: A token in more documents than this goes around the owners.
HOT = 20_000
#: Bits of the broadcast filter over documents to verify: 4 MB.
FILTER_BITS = 1 << 25
#: Sparse rounds before the whole one, which takes all that is left; classes drawn
#: from each token and links tried by a class in each.
ROUNDS, HEADS, TRIES = 2, (1, 4), (8, 32)
#: A class's short bitmap, and longs of its wide one, which folds to the short one.
_SHORT = [f"s{k}" for k in range(4)]
WIDE = 16
#: A token of so many entries is joined by short bitmaps: at most as many rows for
#: each entry.  Beyond it the wide ones decide inside the join, and only sets of a
#: like length meet: those in one band or in bands side by side.
LIGHT = 8
BAND = 1.0001 * float(np.log(4 / 3))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1


def _bitmap(tokens: np.ndarray) -> bytes:
    """Whether so many tokens fall on each bit is odd, for a power of two of about
    2n bits, 64 at least.  Common tokens of two sets cancel out in the difference."""
    size = 64 << max(0, int(np.ceil(np.log2(max(1, 2 * len(tokens)) / 64))))
    return np.packbits(_odd(tokens, size), bitorder="little").tobytes()


def _odd(tokens: np.ndarray, size: int) -> np.ndarray:
    return (np.bincount((mix(tokens, 11) & _U(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)


def _wide_bitmap(tokens: np.ndarray) -> np.ndarray:
    """1024 such bits as longs, for a first look inside a join."""
    return np.packbits(_odd(tokens, 64 * WIDE)).view(np.int64)


def _hash_prefix(tokens: np.ndarray, salt: int) -> bytes:
    """The first tokens in a hash order, as sorted 32-bit values of that hash."""
    h, p = mix(tokens, salt), prefix_length(len(tokens))
    low = np.partition(h, p - 1)[:p] if p < len(h) else h
    # within the prefix, low bits tell tokens apart
    return np.sort((low & _U(0xFFFFFFFF)).astype(np.uint32)).tobytes()


def _class_of(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        a, b = mix(tokens, 21).sum(dtype=np.uint64), mix(tokens, 22).sum(dtype=np.uint64)
        return int(mix(np.array([a ^ (b << _U(1)) ^ (b >> _U(63)) ^ _U(len(tokens))], dtype=np.uint64), 23).view(np.int64)[0])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and at the end one with the partition's sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int32()), ("cls", pa.int64()), ("bits", pa.binary()), ("second", pa.binary()), ("third", pa.binary()), ("wide", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int32)

    def rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    for batch in (part for whole in batches for part in parts(whole)):
        out = []
        for doc_id, row, tokens in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(_texts(batch))):
            if len(tokens):
                sketch += np.bincount((tokens >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.int32) if len(tokens) > 5000 else 0
                if len(tokens) <= 5000:
                    np.add.at(sketch, (tokens >> _U(64 - SKETCH_BITS)).astype(np.int64), 1)
                out.append((doc_id, row, len(tokens), _class_of(tokens), _bitmap(tokens), _hash_prefix(tokens, 12), _hash_prefix(tokens, 13), _wide_bitmap(tokens), None))
            else:
                out.append((doc_id, row, 0, *[None] * 6))
            if len(out) >= 500:
                yield rows(out)
                out = []
        if out:
            yield rows(out)
    if sketch.any():
        yield rows([(None, None, -1, *[None] * 5, sketch)])


def _prefixes(shared, owners: int, hot: float):
    """Blobs (owner, tokens, classes, places) of a partition's order-1 prefixes.

    A place is the token's position in the order, in 255ths of the set, rounded
    down.  Hot tokens, which many classes hold for certain, go to negative
    owners that only pass them on.
    """
    schema = pa.schema([("owner", pa.int32()), ("tokens", pa.binary()), ("classes", pa.binary()), ("places", pa.binary())])

    def flush(held: list) -> pa.RecordBatch:
        t, c, q = (np.concatenate(x) for x in zip(*held))
        owner = ((t & _U(0x7FFFFFFF)).astype(np.int64) * owners) >> 31
        many = shared.value[(t >> _U(64 - SKETCH_BITS)).astype(np.int64)] > hot
        owner[many] = -1 - TaskContext.get().partitionId()
        order = np.argsort(owner, kind="stable")
        owner, t, c, q = owner[order], t[order], c[order], q[order]
        cut = np.flatnonzero(np.diff(owner)) + 1
        rows = [(int(o[0]), x.tobytes(), y.tobytes(), z.tobytes()) for o, x, y, z in zip(*(np.split(k, cut) for k in (owner, t, c, q)))]
        return pa.RecordBatch.from_arrays([pa.array(k, type=f.type) for k, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = shared.value
        held, size = [], 0
        for batch in (part for whole in batches for part in parts(whole)):
            for s in shingle_sets(_texts(batch)):
                if not len(s):
                    continue
                seen = sketch[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)]
                key = (np.minimum(seen, (1 << 23) - 1).astype(np.uint64) << _U(40)) | (mix(s, 14) >> _U(24))
                first = s[np.argsort(key, kind="stable")[: prefix_length(len(s))]]
                held.append((first, np.full(len(first), _class_of(s), dtype=np.int64), (np.arange(len(first)) * 255 // len(s)).astype(np.uint8)))
                size += len(first)
                if size >= 1 << 19:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _shared_tokens(table: pa.Table) -> pa.Table:
    """An owner's work: the distinct (token, class) of tokens in several classes."""
    read = lambda name, kind: np.concatenate([np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()])
    t, c, q = read("tokens", np.uint64), read("classes", np.int64), read("places", np.uint8)
    order = np.lexsort((c, t))
    t, c, q = t[order], c[order], q[order]
    new = np.ones(len(t), dtype=bool)
    new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
    t, c, q = t[new], c[new], q[new]
    hot = table.column("owner")[0].as_py() < 0
    if not hot:
        same = np.concatenate([[False], t[1:] == t[:-1]])
        several = same | np.concatenate([same[1:], [False]])
        t, c, q = t[several], c[several], q[several]
    return pa.table({"token": pa.array(t.view(np.int64)), "cls": pa.array(c), "place": pa.array(q.astype(np.int32)), "hot": pa.array(np.full(len(t), hot))})


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def bitmaps_allow(n1: int, n2: int, bits1: bytes, bits2: bytes) -> bool:
    """Whether the bitmaps of two sets allow the overlap that a link needs."""
    a, b = np.frombuffer(bits1, dtype=np.uint8), np.frombuffer(bits2, dtype=np.uint8)
    size = min(len(a), len(b))
    differ = int(np.bitwise_count(_fold(a, size) ^ _fold(b, size)).sum())
    # each differing bit needs a token that one set lacks
    return 7 * ((n1 + n2 - differ) // 2) >= 3 * (n1 + n2)


def prefixes_meet(x: bytes, y: bytes) -> bool:
    """Whether two prefixes under one order share a token."""
    p, q = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
    return bool((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).any())


def _by_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [bitmaps_allow(*x) for x in zip(*(batch.column(n).to_pylist() for n in ("n1", "n2", "bits1", "bits2")))]
        yield batch.select(["a", "b"]).filter(pa.array(ok, type=pa.bool_()))


def _by_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [prefixes_meet(*x[:2]) and prefixes_meet(*x[2:]) for x in zip(*(batch.column(n).to_pylist() for n in ("second1", "second2", "third1", "third2")))]
        yield batch.select(["a", "b"]).filter(pa.array(ok, type=pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = []
        for x, y in zip(batch.column("set1"), batch.column("set2")):
            p, q = (np.frombuffer(k.as_buffer(), dtype=np.uint64) for k in (x, y))
            at = np.minimum(np.searchsorted(p, q), len(p) - 1)
            both = int((p[at] == q).sum())
            ok.append(100 * both >= 75 * (len(p) + len(q) - both))
        yield batch.select(["a", "b"]).filter(pa.array(ok, type=pa.bool_()))


class _Join:
    """One join's tables: documents, classes, and the shared tokens."""

    def __init__(self, docs: DataFrame):
        self.spark = docs.sparkSession
        self.docs = docs
        everything = durable(docs.mapInArrow(_signatures, "doc_id long, row long, n int, cls long, bits binary, second binary, third binary, wide array<long>, counts array<int>"), "signatures")
        short = {x: _xor([F.col("wide")[j] for j in range(k, WIDE, len(_SHORT))]) for k, x in enumerate(_SHORT)}
        self.signatures = everything.filter("n >= 0").withColumns(short)
        self.classes = durable(self.signatures.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.min("n").alias("n"), *[F.min(x).alias(x) for x in _SHORT]), "classes")
        # a fixed number of counters, summed where the partitions are
        sums = everything.filter("n = -1").select(F.posexplode("counts").alias("k", "c")).filter("c > 0").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        sketch[sums.column("k").to_numpy()] = sums.column("c").to_numpy()
        usual = float(np.median(sketch))
        total = int(sketch.sum()) // 4
        owners = max(4, -(-total // OWNER_ROWS))
        blobs = docs.mapInArrow(_prefixes(self.spark.sparkContext.broadcast(sketch), owners, usual + 8 * usual**0.5 + HOT), "owner int, tokens binary, classes binary, places binary")
        held = durable(blobs.groupBy("owner").applyInArrow(_shared_tokens, "token long, cls long, place int, hot boolean"), "held")
        # a class that several partitions hold sent its hot tokens from each
        once = held.filter("hot").groupBy("token", "cls").agg(F.min("place").alias("place"))
        self.entries = durable(held.filter("NOT hot").select("token", "cls", "place").unionByName(once).join(self.classes.select("cls", "n"), "cls").withColumn("comp", F.col("cls")), "entries")
        wanted = held.select("cls").distinct().join(self.classes, "cls")
        # one row stands for a class, by its hash, as ids may be null or repeat
        own = wanted.select("row", "cls")
        self.records = durable(self.signatures.join(own, ["row", "cls"]).select("cls", "row", "n", "bits", "second", "third", "wide").dropDuplicates(["cls"]), "records")
        release(held)
        # what the answer needs of the signatures is a few bytes a row
        self.signatures = durable(self.signatures.select("doc_id", "row", "n", "cls"), "documents")
        release(everything)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of classes that link."""
        def side(k: int, name: str, *columns: str) -> DataFrame:
            return self.records.select(F.col("cls").alias(name), *[F.col(c).alias(f"{c}{k}") for c in columns])

        def through(left: DataFrame, run, *columns: str) -> DataFrame:
            return left.join(side(1, "a", *columns), "a").join(side(2, "b", *columns), "b").mapInArrow(run, "a long, b long")

        passed = durable(through(through(pairs, _by_bitmaps, "n", "bits"), _by_prefixes, "second", "third"), "passed")
        ids = passed.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(self.records.select("cls", "row"), "cls")
        word, bit = f"cast(pmod(row, {FILTER_BITS}) div 32 AS int)", f"cast(pmod(row, {FILTER_BITS}) % 32 AS int)"
        words = ids.select(F.expr(word).alias("w"), F.expr(f"shiftleft(1L, {bit})").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        table = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
        table[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint32)
        shared = self.spark.sparkContext.broadcast(table)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (part for whole in batches for part in parts(whole)):
                at = batch.column(2).to_numpy() % FILTER_BITS
                some = batch.filter(pa.array((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))
                sets = list(shingle_sets(_texts(some)))
                kept = [k for k, s in enumerate(sets) if len(s)]
                yield pa.RecordBatch.from_arrays([some.column(2).take(pa.array(kept, type=pa.int64())), pa.array([_class_of(sets[k]) for k in kept], type=pa.int64()), pa.array([sets[k].tobytes() for k in kept], type=pa.binary())], names=["row", "cls", "tokens"])

        sets = durable(self.docs.mapInArrow(whole, "row long, cls long, tokens binary").join(ids, ["row", "cls"]).select("cls", "tokens").dropDuplicates(["cls"]), "sets")
        both = passed.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("set1")), "a").join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("set2")), "b")
        links = durable(both.mapInArrow(_verify, "a long, b long"), "links")
        for t in (passed, sets):
            release(t)
        return links

    def settle(self, roots: DataFrame) -> None:
        """Bring the entries' components up to date; a token whose classes are all
        in one component gives no candidate any more and goes.

        From here on an entry also holds its class's short bitmap, ``main``, the
        component with most of the token's entries, and ``size``, their number.
        """
        before = self.entries
        kept = before.drop("main", "size").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")
        at = kept if "s0" in kept.columns else kept.join(self.classes.select("cls", *_SHORT), "cls")
        each = kept.groupBy("token", "comp").agg(F.count("*").alias("k"))
        open_ = each.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("s"), F.count("*").alias("comps"), F.sum("k").alias("size")).filter("comps > 1").select("token", F.col("s.comp").alias("main"), "size")
        self.entries = durable(at.join(open_, "token"), "entries")
        release(before)

    def sparse(self, turn: int) -> DataFrame:
        """A few pairs for each class, with other components' classes of the same token,
        drawn anew by hash each turn.

        After the first turn only classes outside a token's main component look
        for others, among several of each token, and try those nearest by bitmap.
        """
        later = turn > 0
        short = [F.col(x).alias(f"head_{x}") for x in _SHORT] if later else []
        drawn = [F.max(F.struct(F.xxhash64("token", "cls", F.lit(turn), F.lit(j)).alias("h"), F.col("cls").alias("head"), F.col("comp").alias("head_comp"), F.col("n").alias("head_n"), F.col("place").alias("head_place"), *short)) for j in range(HEADS[turn])]
        heads = self.entries.groupBy("token").agg(F.array(*drawn).alias("drawn")).select("token", F.inline("drawn")).drop("h")
        at = self.entries.filter("comp != main") if later else self.entries
        differ = _differ("", "head_") if later else F.lit(0)
        tried = at.join(heads, "token").filter((F.col("comp") != F.col("head_comp")) & _possible("n", "place", "head_n", "head_place"))
        tried = tried.select("cls", "head", "n", "head_n", differ.alias("differ")).filter(_enough("n", "head_n", F.col("differ"))).select("cls", "head", "differ").distinct()
        some = tried.withColumn("r", F.row_number().over(W.partitionBy("cls").orderBy("differ", F.xxhash64("head", "cls", F.lit(turn))))).filter(F.col("r") <= TRIES[turn])
        return some.select(F.least("cls", "head").alias("a"), F.greatest("cls", "head").alias("b")).distinct()

    def rest(self) -> DataFrame:
        """Every pair that shares a token across components.

        Within a token's entries one side is never of the largest component, so
        a group of near copies that is already joined meets only the others.
        Entries of a token that many classes hold carry the wide bitmap: of a
        family of texts that are just too far apart few pairs leave the join.
        """
        few = self.entries.filter(F.col("size") <= LIGHT)
        many = durable(self.entries.filter(F.col("size") > LIGHT).select("token", "cls", "n", "comp", "place", "main").join(self.records.select("cls", "wide"), "cls"), "many")
        pairs = durable(self._meet(few, _SHORT, _differ).unionByName(self._meet(many, ["wide"], _differ_wide, banded=True)).distinct(), "pairs")
        release(many)
        release(self.entries)
        return pairs

    def _meet(self, entries: DataFrame, bits: list[str], differ, banded: bool = False) -> DataFrame:
        def side(name: str) -> list:
            return [F.col(old).alias(f"{name}_{old}") for old in ("cls", "n", "comp", "place", *bits)]

        keys, left, right = ["token"], entries.filter("comp != main").select("token", "main", *side("x")), entries.select("token", *side("y"))
        if banded:
            keys, band = ["token", "band"], lambda n: F.floor(F.ln(n) / BAND).cast("int")
            left = left.select("*", F.explode(F.sequence(band("x_n") - 1, band("x_n") + 1)).alias("band"))
            right = right.withColumn("band", band("y_n"))
        # of two classes outside the largest component the lesser one is on the left
        once = (F.col("y_comp") == F.col("main")) | (F.col("x_cls") < F.col("y_cls"))
        met = left.join(right, keys).filter((F.col("x_comp") != F.col("y_comp")) & once & _possible("x_n", "x_place", "y_n", "y_place") & _enough("x_n", "y_n", differ("x_", "y_")))
        return met.select(F.least("x_cls", "y_cls").alias("a"), F.greatest("x_cls", "y_cls").alias("b"))


def _xor(columns: list):
    out = columns[0]
    for c in columns[1:]:
        out = out.bitwiseXOR(c)
    return out


def _differ_wide(one: str, other: str):
    """Bits in which two wide bitmaps differ."""
    a, b = F.col(f"{one}wide"), F.col(f"{other}wide")
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(WIDE)), F.lit(0))


def _differ(one: str, other: str):
    """Bits in which two short bitmaps differ; each needs a token that one set lacks."""
    return sum((F.bit_count(F.col(f"{one}{x}").bitwiseXOR(F.col(f"{other}{x}"))) for x in _SHORT), F.lit(0))


def _enough(n1: str, n2: str, differ):
    """Whether so many lacking tokens allow the overlap that a link needs."""
    return 7 * F.floor((F.col(n1) + F.col(n2) - differ) / 2) >= 3 * (F.col(n1) + F.col(n2))


def _possible(n1: str, p1: str, n2: str, p2: str):
    """Whether lengths and places allow a link whose first common token is this one.

    Before it nothing is common, so the overlap is at most what is left from it
    on; a link has such a token, so none is lost.
    """
    lengths = 4 * F.least(n1, n2) >= 3 * F.greatest(n1, n2)
    left = F.least(F.col(n1) - F.floor(F.col(p1) * F.col(n1) / 255), F.col(n2) - F.floor(F.col(p2) * F.col(n2) / 255))
    return lengths & (7 * left >= 3 * (F.col(n1) + F.col(n2)))


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, row, n_shingles, root, component_id, class_id of every row; the last
    three are null without shingles."""
    with tables() as keep:
        return keep(durable(_joined(docs, id_col, text_col), "components"))


def _joined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), row_hash(id_col, text_col).alias("row"))
    join = _Join(rows)
    links, roots = None, None
    for turn in range(ROUNDS + 1):
        found = join.verified(join.sparse(turn) if turn < ROUNDS else join.rest())
        links = found if links is None else links.unionByName(found)
        before, roots = roots, durable(components(links), "roots")
        if before is not None:
            release(before)
        if turn < ROUNDS:
            join.settle(roots)
    comps = join.classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = comps.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = comps.join(least, "root").select("cls", "root", F.col("rep").alias("class_id"), "component_id")
    return join.signatures.select("doc_id", "row", F.col("n").cast("long").alias("n_shingles"), "cls").join(named, "cls", "left").drop("cls")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, class_id.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text of
    fewer than five words is one shingle, one without words (or null) has none
    and links with nothing.  Documents link when 100 * intersection >= 75 *
    union; component_id is the least doc_id reachable, class_id the least
    doc_id with an equal set, both null where all these ids are.  Rows may repeat
    and ids may be null: a row links by its text; other columns are ignored.
    """
    own = lambda c: F.coalesce(c, "doc_id").alias(c)
    return _components(docs, id_col, text_col).select("doc_id", "n_shingles", own("component_id"), own("class_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one of each group left, columns unchanged.

    The row with the least id stays; of several with that id in the group (rows
    that repeat, or near copies under one id) one.  A row goes or stays by its
    own id and text.  Rows without words all stay.
    """
    rows = _components(docs, id_col, text_col).filter("root IS NOT NULL")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = rows.filter(~first).select("row", F.lit(False).alias("once")).distinct()
    # the rows under the least id: one in most groups
    each = rows.filter(first).groupBy("root", "row").agg(F.count("*").alias("k"))
    each = each.withColumn("once", F.col("row") == F.min("row").over(W.partitionBy("root"))).filter("NOT once OR k > 1")
    return without(docs, row_hash(id_col, text_col), durable(gone.unionByName(each.select("row", "once")), "verdicts"))
