"""Recall: time windows, tags, exact and approximate neighbours, tombstones."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import has_tag
from ..functions.vectors import cosine
from ..storage import durable, release


def newest(df: DataFrame, limit: int, deleted: Column | None = None) -> DataFrame:
    """Live rows, newest first."""
    live = df if deleted is None else df.filter(~deleted)
    return live.orderBy(F.desc("created_at"), "id").limit(limit)


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Upsert semantics: one row a key, the first in order."""
    own = W.partitionBy(key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(own)).filter("__r = 1").drop("__r")


def recent(df: DataFrame, now: float, hours: float, limit: int, tags: list[str] = []) -> DataFrame:
    """Rows of the last hours (the bound included), by tag, then cut to the limit."""
    return df.filter(F.col("created_at") >= now - hours * 3600).filter(has_tag(F.col("tags"), tags)).orderBy(F.desc("created_at"), "id").limit(limit)


def nearest(vectors: DataFrame, query: DataFrame, limit: int, least: float = 0.0, live: DataFrame | None = None) -> DataFrame:
    """The top rows by cosine with one query vector (a one-row frame ``q``).

    With ``live``, rows whose id isn't there go before the cut.
    """
    scored = vectors.crossJoin(F.broadcast(query.select("q").limit(1))).withColumn("score", cosine(F.col("embedding"), F.col("q")))
    if live is not None:
        scored = scored.join(live.select("id"), "id", "left_semi")
    # the cut is by score, so what is too low may go after it; a filter before it would make each score twice
    return scored.drop("q").orderBy(F.desc("score"), "id").limit(limit).filter(F.col("score") >= least)


def _blocks(rows: int):
    """Batches of (id, embedding) as one row each: ids, and a unit float matrix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                dims = max((len(x) for x in part.column(1)), default=0)
                m = np.array([x.as_py() if len(x) == dims else [0.0] * dims for x in part.column(1)], dtype=np.float64)
                size = np.linalg.norm(m, axis=1, keepdims=True)
                m = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([m.tobytes()]), pa.array([dims], type=pa.int32()), pa.array([None], type=pa.binary())], names=["ids", "m", "dims", "err"])

    return run


#: Queries whose scores with a block of rows a task holds at a time.
_AT_ONCE = 512


def _products(queries: DataFrame, rows: DataFrame, keep: Callable[..., tuple[np.ndarray, np.ndarray]], sizes: tuple[int, int]) -> DataFrame:
    """(query, id, score, err) of what ``keep`` (scores, ids, errors -> places) takes of
    each pair of blocks.

    ``sizes``: blocks of queries and of rows, about.  Each is dealt over as many keys
    (rows over as many as there are shuffle partitions, at least), and a pair of keys is
    a group, so that a task holds a few blocks of either side however many there are.
    """
    q_keys, keys = max(1, sizes[0]), max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), sizes[1])
    key = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("q_key", key(q_keys)).withColumn("key", each(keys))
    right = rows.withColumn("key", key(keys)).withColumn("q_key", each(q_keys))

    def matrix(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, dims = np.frombuffer(r["ids"].as_py(), np.int64), r["dims"].as_py()
        m = r["m"].as_py()
        m = np.frombuffer(m, np.float64 if len(m) == 8 * len(ids) * dims else np.float32).reshape(len(ids), dims)
        err = r["err"].as_py()
        return ids, m, np.zeros(len(ids)) if err is None else np.frombuffer(err, np.float64)

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        out = []
        for i in range(held.num_rows):
            ids, m, err = matrix({c: held[c][i] for c in ("ids", "m", "dims", "err")})
            for j in range(asked.num_rows):
                q_ids, q, _ = matrix({c: asked[c][j] for c in ("ids", "m", "dims", "err")})
                if q.shape[1] != m.shape[1] or not m.shape[1]:
                    continue
                for at in range(0, len(q), _AT_ONCE):
                    score = (q[at : at + _AT_ONCE] @ m.T).astype(np.float64)
                    x, y = keep(score, ids, err)
                    out.append((q_ids[at + x], ids[y], score[x, y], err[y]))
        kinds = (np.int64, np.int64, np.float64, np.float64)
        return pa.table({c: np.concatenate([o[k] for o in out]) if out else np.empty(0, kind) for k, (c, kind) in enumerate(zip(("query", "id", "score", "err"), kinds))})

    both = ("key", "q_key")
    return left.groupBy(*both).cogroup(right.groupBy(*both)).applyInArrow(run, "query long, id long, score double, err double")


_BLOCK = "ids binary, m binary, dims int, err binary"


def _first(order: tuple[np.ndarray, ...], x: np.ndarray, limit: int) -> np.ndarray:
    """Places of the first few of each ``x`` by ``order`` (the last key decides first)."""
    o = np.lexsort((*order, x))
    begin = np.flatnonzero(np.diff(x[o], prepend=-1))
    return o[np.arange(len(o)) - np.repeat(begin, np.diff(begin, append=len(o))) < limit]


def _best(limit: int):
    def top(score: np.ndarray, ids: np.ndarray, err: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # by score, then id
        s, k = np.round(score, 12), min(limit, score.shape[1])
        x, y = np.nonzero(s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None])
        f = _first((ids[y], -s[x, y]), x, limit)
        return x[f], y[f]

    return top


def _within(limit: int):
    """What may be among the best, given how far each score may be off."""

    def may(score: np.ndarray, ids: np.ndarray, err: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = min(limit, score.shape[1])
        sure = np.partition(score - err, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
        return np.nonzero(score + err >= sure)

    return may


def _ranked(pairs: DataFrame, limit: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 12)), "id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= limit)


def _vectors(df: DataFrame, block: int) -> DataFrame:
    return df.select("id", "embedding").mapInArrow(_blocks(block), _BLOCK)


def _sizes(queries: DataFrame, rows: DataFrame, block: int) -> tuple[int, int]:
    """Blocks of queries and of rows."""
    return -(-queries.count() // block), -(-rows.count() // block)


def nearest_each(vectors: DataFrame, queries: DataFrame, limit: int, block: int = 2048) -> DataFrame:
    """(query, id, score, rank) for a stated set of query vectors against all rows.

    Both sides are dealt in blocks; a pair of blocks is one matrix product that
    keeps ``limit`` rows a query, so no pair of rows is ever a row.
    """
    met = _products(_vectors(queries, block), _vectors(vectors, block), _best(limit), _sizes(queries, vectors, block))
    return _ranked(met.drop("err"), limit)


def all_above(vectors: DataFrame, queries: DataFrame, least: float, block: int = 2048) -> DataFrame:
    """(query, id, score) of every pair with a score of ``least`` or more; only
    these leave the product of their blocks."""
    met = _products(_vectors(queries, block), _vectors(vectors, block), lambda score, ids, err: np.nonzero(score >= least), _sizes(queries, vectors, block))
    return met.drop("err")


def _coded(dims: int):
    """Unit vectors as whole numbers of -127 to 127 with a scale; others are an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            m = np.array(batch.column(1).to_pylist(), dtype=object)
            if any(x is None or len(x) != dims for x in m):
                raise ValueError(f"vectors must have {dims} numbers")
            m = np.array(m.tolist(), dtype=np.float64)
            size = np.linalg.norm(m, axis=1, keepdims=True)
            if not np.isfinite(m).all() or not size.all():
                raise ValueError("vectors must be finite and not zero")
            own = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in m]
            m /= size
            scale = (np.abs(m).max(axis=1, keepdims=True) / 127).astype(np.float32)
            codes = np.round(m / scale).astype(np.int8)
            # a unit query's score is off by no more than the length of what is lost
            err = np.linalg.norm(m - codes.astype(np.float32) * scale, axis=1) + 1e-9
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes]), pa.array(scale[:, 0]), pa.array(err), pa.array(own)], names=["id", "code", "scale", "err", "own"])

    return run


def _code_blocks(dims: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                m = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.int8).reshape(-1, dims).astype(np.float32) * part.column(2).to_numpy()[:, None]
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().astype(np.int64).tobytes()]), pa.array([m.tobytes()]), pa.array([dims], type=pa.int32()), pa.array([part.column(3).to_numpy().astype(np.float64).tobytes()])], names=["ids", "m", "dims", "err"])

    return run


class VectorIndex:
    """A written index of coded vectors, kept up to date from a journal of changes.

    A vector is a byte a number, an eighth of what exact search reads.  Every row
    is indexed and met by every query in blocks; all that may be among the best by code,
    whose error is known, are scored again exactly, so none of these is missed.  ``sync`` codes
    only ids that changed since its checkpoint, which moves once they are written;
    another provider or size of vectors, a journal that starts anew or a broken
    checkpoint lead to a rebuild, and so do many changes in a row.
    """

    ROWS, MOST_PARTS = 4096, 8

    def __init__(self, spark: SparkSession, root: str, dims: int, provider: str):
        self.spark, self.root, self.dims, self.key = spark, root, dims, f"{provider}:{dims}:by vector"

    def _checkpoint(self) -> dict | None:
        try:
            row = self.spark.read.parquet(f"{self.root}/checkpoint").first()
        except AnalysisException:
            return None
        return None if row is None or row["key"] != self.key else row.asDict()

    def _write(self, vectors: DataFrame, name: str) -> str:
        folder = f"{self.root}/{name}-{uuid.uuid4().hex}"
        vectors.select(F.col("id").cast("long").alias("id"), "embedding").mapInArrow(_coded(self.dims), "id long, code binary, scale float, err double, own binary").write.parquet(folder)
        return folder

    def sync(self, vectors: DataFrame, journal: DataFrame) -> dict:
        """Bring the index up to the journal (seq, id): rebuild, changed, checkpoint."""
        seq = journal.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        had = self._checkpoint()
        rebuild = had is None or had["seq"] > seq or len(had["parts"]) >= self.MOST_PARTS
        if not rebuild and had["seq"] == seq:
            return {"rebuild": False, "changed": 0, "checkpoint": seq}
        if rebuild:
            parts, gone, changed = [self._write(vectors, "codes")], [""], vectors.count()
        else:
            ids = durable(journal.filter(F.col("seq") > had["seq"]).select(F.col("id").cast("long").alias("id")).distinct(), "changed")
            folder = f"{self.root}/gone-{uuid.uuid4().hex}"
            ids.write.parquet(folder)
            parts, gone, changed = [*had["parts"], self._write(vectors.join(ids, "id", "left_semi"), "codes")], [*had["gone"], folder], ids.count()
            release(ids)
        state = self.spark.createDataFrame([(self.key, seq, parts, gone)], "key string, seq long, parts array<string>, gone array<string>")
        state.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/checkpoint")
        return {"rebuild": rebuild, "changed": changed, "checkpoint": seq}

    def codes(self) -> DataFrame:
        """(id, code, scale, err, own) of what the index holds: a part's rows but for ids that
        changed later."""
        had = self._checkpoint()
        if had is None:
            raise RuntimeError("the index must be synced first")
        read = self.spark.read.parquet
        out = read(had["parts"][0])
        for part, gone in zip(had["parts"][1:], had["gone"][1:]):
            out = out.join(read(gone), "id", "left_anti").unionByName(read(part))
        return out

    def candidates(self, queries: DataFrame, limit: int) -> DataFrame:
        """(query, id) of all rows that may be among a query's best, by code.

        Of one vector's copies only the first by id can be; of the others those whose
        score, were it off as far as it may be, reaches the last of the surely best.
        """
        place = F.row_number().over(W.partitionBy("own").orderBy("id"))
        codes = self.codes()
        rows = codes.withColumn("r", place).filter(F.col("r") <= limit).select("id", "code", "scale", "err").mapInArrow(_code_blocks(self.dims, self.ROWS), _BLOCK)
        met = durable(_products(_vectors(queries, self.ROWS), rows, _within(limit), _sizes(queries, codes, self.ROWS)), "met")
        sure = F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.col("score") - F.col("err"))))
        last = met.withColumn("r", sure).filter(F.col("r") <= limit).groupBy("query").agg(F.min(F.col("score") - F.col("err")).alias("sure"))
        return met.join(last, "query").filter(F.col("score") + F.col("err") >= F.col("sure")).select("query", "id")


def nearest_approx(index: VectorIndex, vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """(query, id, score, rank): what may be among the best by code, scored exactly."""
    found = index.candidates(queries, limit)
    asked = queries.select(F.col("id").alias("query"), F.col("embedding").alias("q"))
    # a few candidates a query meet their vectors by id
    scored = vectors.select("id", "embedding").join(found, "id").join(asked, "query").select("query", "id", cosine(F.col("embedding"), F.col("q")).alias("score"))
    return _ranked(scored, limit)


def overlap_at_k(exact: DataFrame, found: DataFrame) -> DataFrame:
    """(query, recall): share of the exact ids that were found; 1 without any."""
    a = exact.groupBy("query").agg(F.collect_set("id").alias("a"))
    b = found.groupBy("query").agg(F.collect_set("id").alias("b"))
    both = a.join(b, "query", "left").withColumn("b", F.coalesce("b", F.array().cast("array<bigint>")))
    return both.select("query", F.when(F.size("a") == 0, 1.0).otherwise(F.size(F.array_intersect("a", "b")) / F.size("a")).alias("recall"))


def forget(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose id isn't forgotten; for each of the stores alike."""
    return df.join(gone.select("id").distinct(), "id", "left_anti")


def tagged_ids(df: DataFrame, tags: list[str]) -> DataFrame:
    """Ids to forget by tag; no tags name nothing."""
    own = has_tag(F.col("tags"), tags) if tags else F.lit(False)
    return df.filter(own).select("id")


def working_set(puts: DataFrame, now: float, ttl: float, capacity: int) -> DataFrame:
    """What a bounded working memory holds: unexpired, the last put or read first kept."""
    alive = puts.filter(F.col("created_at") >= now - ttl)
    each = latest(alive, "id", [F.desc("put_at")])
    return each.orderBy(F.desc("put_at"), "id").limit(capacity).orderBy(F.desc("created_at"), "id")


def neighbour_window(seeds: DataFrame, messages: DataFrame, window: float) -> DataFrame:
    """Messages within ``window`` seconds of a seed, under their first seed.

    ``seeds``: seed, at, seed_score, seed_rank; ``messages``: id, created_at,
    score.  A band join on time bins; a neighbour's score is the larger of 0.6
    of its own and 0.35 of its seed's.
    """
    bin_of = lambda t: F.floor(t / window).cast("long")
    left = seeds.withColumn("bin", F.explode(F.array(bin_of(F.col("at")) - 1, bin_of(F.col("at")), bin_of(F.col("at")) + 1)))
    met = messages.withColumn("bin", bin_of(F.col("created_at"))).join(left, "bin").filter((F.col("created_at") >= F.col("at") - window) & (F.col("created_at") <= F.col("at") + window))
    score = F.when(F.col("id") == F.col("seed"), F.col("seed_score")).otherwise(F.greatest(F.col("score") * 0.6, F.col("seed_score") * 0.35))
    first = W.partitionBy("id").orderBy(F.when(F.col("id") == F.col("seed"), 0).otherwise(1), "seed_rank")
    return met.withColumn("r", F.row_number().over(first)).filter("r = 1").select("id", "seed", score.alias("score"))
