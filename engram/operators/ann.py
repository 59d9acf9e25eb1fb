"""Approximate neighbours by a layered proximity graph in each shard.

Rows are dealt to shards by a hash of the id.  A shard's graph is built in numpy
from blocks of exact products: each node links to near rows that are not nearer to
one another than to it, and back; every layer above holds a sixteenth of the nodes
of the one below.  A query walks down the layers and then searches the lowest with
a beam, all queries of a block at a time; the results of the shards are merged.  A
query that is a vector of the shard begins at it, too, and always finds it.  How wide
the beam must be for such queries and for others, each shard finds out for itself:
some of its rows are searched for, as they are and as if they weren't in it, and held
against exact products.

The index is a table of one row a shard, written as Parquet.  It follows a journal:
only shards with changed ids are built again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..storage import durable, release
from .recall import VectorIndex

#: Rows of a shard, about; links of a node that it chooses itself (it keeps twice as
#: many with those that choose it); near rows that it chooses from; nodes of a layer
#: for each of the next.
SHARD, LINKS, NEAR, LAYER = 1 << 13, 12, 96, 16
#: Rows held best during a search, at least, and queries that one task searches for.
BEAM, QUERIES = 24, 1024
#: Rows of a shard that its beam is fitted on, at most; the share of their nearest so
#: many that it must find.
TRIED, FOUND, NEAREST = 128, 0.93, 10
_BLOCK = 512

_SHARD = "shard int, n int, beam int, own_beam int, ids binary, ends binary, vectors binary, layers array<struct<nodes:binary,ends:binary,links:binary>>"


def _near(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, likeness) of each row's nearest others, nearest first."""
    n = len(x)
    k = min(most, n - 1)
    at, like = np.empty((n, k), dtype=np.int64), np.empty((n, k), dtype=np.float32)
    for a in range(0, n, _BLOCK):
        s = x[a : a + _BLOCK] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
        own = np.take_along_axis(s, best, axis=1)
        order = np.argsort(-own, axis=1, kind="stable")
        at[a : a + _BLOCK], like[a : a + _BLOCK] = np.take_along_axis(best, order, axis=1), np.take_along_axis(own, order, axis=1)
    return at, like


def _diverse(x: np.ndarray, at: np.ndarray, like: np.ndarray, most: int) -> np.ndarray:
    """Which of each row's candidates (nearest first; -1 is none) it links to: those
    nearer to it than to any that it took before."""
    keep = np.zeros(at.shape, dtype=bool)
    for a in range(0, len(at), _BLOCK // 2):
        own, c = slice(a, a + _BLOCK // 2), x[np.maximum(at[a : a + _BLOCK // 2], 0)]
        among = c @ c.transpose(0, 2, 1)
        taken, count = keep[own], np.zeros(len(c), dtype=int)
        for t in range(at.shape[1]):
            hidden = (taken & (among[:, t] >= like[own, t, None])).any(axis=1)
            taken[:, t] = (at[own, t] >= 0) & ~hidden & (count < most)
            count += taken[:, t]
        keep[own] = taken
    return keep


def _links(x: np.ndarray, links: int) -> list[np.ndarray]:
    """Neighbours of each row of one layer."""
    n = len(x)
    if n < 2:
        return [np.empty(0, dtype=np.int32)] * n
    at, like = _near(x, NEAR)
    keep = _diverse(x, at, like, links)
    a = np.repeat(np.arange(n), keep.sum(axis=1))
    b, s = at[keep], like[keep]
    pairs = np.unique(np.concatenate([a * n + b, b * n + a]), return_index=True)
    a, b, s = pairs[0] // n, pairs[0] % n, np.concatenate([s, s])[pairs[1]]
    order = np.lexsort((-s, a))
    a, b, s = a[order], b[order], s[order]
    begin = np.searchsorted(a, np.arange(n + 1))
    # where others chose a row too often, the diverse of its nearest stay
    wide = 4 * links
    place = np.arange(len(a)) - begin[a]
    many = np.flatnonzero(np.diff(begin) > 2 * links)
    out = [b[begin[k] : begin[k + 1]].astype(np.int32) for k in range(n)]
    if len(many):
        at, like = np.full((len(many), wide), -1, dtype=np.int64), np.zeros((len(many), wide), dtype=np.float32)
        own = np.isin(a, many) & (place < wide)
        line = np.searchsorted(many, a[own])
        at[line, place[own]], like[line, place[own]] = b[own], s[own]
        keep = _diverse(x, at, like, 2 * links)
        for k, row, kept in zip(many, at, keep):
            out[k] = row[kept].astype(np.int32)
    return out


def build(x: np.ndarray, seed: int = 17) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(nodes, ends, links) of each layer, the lowest first; links are places in
    ``nodes`` of the layer, those of a node end at its entry of ``ends``."""
    nodes, out, rng = np.arange(len(x), dtype=np.int32), [], np.random.default_rng(seed)
    while True:
        found = _links(x[nodes], LINKS)
        out.append((nodes, np.cumsum([len(f) for f in found], dtype=np.int32), np.concatenate(found) if found else np.empty(0, np.int32)))
        if len(nodes) <= 2 * LAYER:
            return out
        nodes = np.sort(rng.choice(nodes, len(nodes) // LAYER, replace=False))


def _walk(x: np.ndarray, layer: tuple, q: np.ndarray, entry: np.ndarray, beam: int, hidden: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beam search of all queries in one layer: (node, likeness) best first, and the
    likenesses computed for each query.  ``entry``: nodes to begin with (-1: none), each
    once; ``hidden``: one for each query that it never meets (-1: none)."""
    nodes, ends, links = layer
    v, n, m = x[nodes], len(nodes), len(q)
    begin, degree = np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
    table = np.full((n, max(1, degree.max(initial=0))), -1, dtype=np.int64)
    line = np.repeat(np.arange(n), degree)
    table[line, np.arange(len(line)) - begin[line]] = links
    seen, count = np.zeros((m, n), dtype=bool), np.zeros(m, dtype=np.int64)
    at, like, done = np.full((m, beam), -1, dtype=np.int64), np.full((m, beam), -np.inf, dtype=np.float32), np.ones((m, beam), dtype=bool)

    def meet(rows: np.ndarray, new: np.ndarray) -> None:
        """Candidates of some queries into their beams."""
        fresh = (new >= 0) & ~seen[rows[:, None], np.maximum(new, 0)]
        line, col = np.nonzero(fresh)
        seen[rows[line], new[line, col]] = True
        count[rows] += fresh.sum(axis=1)
        s = np.full(new.shape, -np.inf, dtype=np.float32)
        s[line, col] = np.einsum("ij,ij->i", v[new[line, col]], q[rows[line]])
        all_at, all_s = np.hstack([at[rows], np.where(fresh, new, -1)]), np.hstack([like[rows], s])
        all_done = np.hstack([done[rows], ~fresh])
        order = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
        at[rows], like[rows], done[rows] = (np.take_along_axis(z, order, axis=1) for z in (all_at, all_s, all_done))

    if hidden is not None:
        none = np.flatnonzero(hidden >= 0)
        seen[none, hidden[none]] = True
    meet(np.arange(m), entry)
    while True:
        rows = np.flatnonzero(~done.all(axis=1))
        if not len(rows):
            return np.where(at >= 0, nodes[np.maximum(at, 0)], -1), like, count
        first = np.argmin(done[rows], axis=1)
        done[rows, first] = True
        meet(rows, table[at[rows, first]])


def search(x: np.ndarray, layers: list[tuple], q: np.ndarray, beam: int, same: np.ndarray | None = None, hidden: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, likeness, likenesses computed) of unit queries, best first.  ``same``: a node
    for each query that the lowest layer begins with as well (-1: none); ``hidden``: one
    that the search doesn't meet there."""
    total = np.zeros(len(q), dtype=np.int64)
    found = np.tile(layers[-1][0][:1], (len(q), 1))
    for depth in range(len(layers) - 1, -1, -1):
        # found nodes by their place in this layer; a layer holds all nodes of those above
        entry = np.where(found >= 0, np.searchsorted(layers[depth][0], found), -1)
        if depth == 0 and same is not None:
            entry = np.hstack([entry, np.where(entry[:, 0] == same, -1, same)[:, None]])
        if depth == 0 and hidden is not None:
            # a search that came down at what is hidden goes on from its links
            entry = _beside(layers[0], entry, hidden)
        found, like, n = _walk(x, layers[depth], q, entry, beam if depth == 0 else 1, hidden if depth == 0 else None)
        total += n
    return found, like, total


def _beside(layer: tuple, entry: np.ndarray, hidden: np.ndarray) -> np.ndarray:
    """Nodes to begin with, a hidden one's links in its place."""
    _, ends, links = layer
    begin = np.concatenate([[0], ends[:-1]])
    out = [links[begin[h] : ends[h]] if h in e else e for e, h in zip(entry, hidden)]
    wide = np.full((len(out), max(1, *map(len, out))), -1, dtype=np.int64)
    for line, e in zip(wide, out):
        line[: len(e)] = e
    return wide


def fitted(x: np.ndarray, layers: list[tuple], held: bool, seed: int = 17) -> int:
    """The beam that finds ``FOUND`` of the nearest, or the one of all rows, tried with
    some of the rows: for queries that the graph holds, or else for those that it
    doesn't, where each is hidden from its own search."""
    n = len(x)
    near = min(NEAREST, n - 1)
    if near < 1:
        return BEAM
    own = np.random.default_rng(seed).choice(n, min(TRIED, n), replace=False)
    like = x[own] @ x.T
    like[np.arange(len(own)), own] = np.inf if held else -np.inf
    exact = np.argpartition(-like, near - 1, axis=1)[:, :near]
    beam = BEAM
    while beam < n:
        found = search(x, layers, x[own], beam, **{"same" if held else "hidden": own})[0][:, :near]
        if np.mean((exact[:, :, None] == found[:, None]).any(axis=2)) >= FOUND:
            break
        beam += beam // 3
    return beam


def _same(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The line of x that each line of q equals (-1: none)."""
    place = {v.tobytes(): k for k, v in enumerate(x)}
    return np.array([place.get(v.tobytes(), -1) for v in q], dtype=np.int64)


def _unit(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
    flat = lists.flatten()
    if flat.null_count or lists.null_count or (np.diff(lists.offsets.to_numpy()) != dims).any():
        raise ValueError(f"vectors must have {dims} numbers")
    return _normal(flat.to_numpy().astype(np.float64).reshape(-1, dims))


def _normal(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    if not np.isfinite(x).all() or not size.all():
        raise ValueError("vectors must be finite and not zero")
    # no negative zeros, so that equal vectors have equal bytes
    return (x / size).astype(np.float32) + np.float32(0)


def _built(dims: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = _unit(table["embedding"], dims)
        # a node is a vector, however many rows have it; a node's ids end at its entry
        x, node = np.unique(x, axis=0, return_inverse=True)
        node = node.ravel()
        ids = table["id"].to_numpy()[np.argsort(node, kind="stable")]
        ends = np.cumsum(np.bincount(node, minlength=len(x)))
        graph = build(x)
        layers = [{"nodes": n.astype("<i4").tobytes(), "ends": e.astype("<i4").tobytes(), "links": k.astype("<i4").tobytes()} for n, e, k in graph]
        layer = pa.list_(pa.struct([(c, pa.binary()) for c in ("nodes", "ends", "links")]))
        cells = [("shard", key[0].as_py(), pa.int32()), ("n", len(ids), pa.int32()), ("beam", fitted(x, graph, False), pa.int32()), ("own_beam", fitted(x, graph, True), pa.int32()), ("ids", ids.astype("<i8").tobytes(), pa.binary()), ("ends", ends.astype("<i4").tobytes(), pa.binary()), ("vectors", x.astype("<f4").tobytes(), pa.binary()), ("layers", layers, layer)]
        return pa.table({name: pa.array([value], type=kind) for name, value, kind in cells})

    return run


def _searched(dims: int, beam: int, limit: int):
    """The best of one shard for a block of queries, with what it cost."""

    def run(shards: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query": [], "id": [], "cost": []}
        if len(shards) and len(queries):
            (r,) = shards.to_pylist()
            flat = lambda b, kind: np.frombuffer(b, dtype=kind)
            x, ids = flat(r["vectors"], "<f4").reshape(-1, dims), flat(r["ids"], "<i8")
            layers = [tuple(flat(layer[c], "<i4") for c in ("nodes", "ends", "links")) for layer in r["layers"]]
            q = _unit(queries["embedding"], dims)
            same = _same(x, q)
            wide = max(beam, r["beam"], r["own_beam"])
            found, cost = np.full((len(q), wide), -1, dtype=np.int64), np.zeros(len(q), dtype=np.int64)
            for rows, own in ((np.flatnonzero(same < 0), r["beam"]), (np.flatnonzero(same >= 0), r["own_beam"])):
                best, _, cost[rows] = search(x, layers, q[rows], max(beam, own), same[rows])
                found[rows, : best.shape[1]] = best
            # a query's own vector stands first, though others may be as like by rounding
            found = np.hstack([same[:, None], np.where(found == same[:, None], -1, found)])
            found = np.take_along_axis(found, np.argsort(found < 0, axis=1, kind="stable"), axis=1)
            asked = queries["query"].to_numpy()
            ends = flat(r["ends"], "<i4").astype(np.int64)
            begin = np.concatenate([[0], ends[:-1]])
            for k in range(min(limit, found.shape[1])):
                ok = np.flatnonzero(found[:, k] >= 0)
                node, q = found[ok, k], asked[ok]
                # the first ids of a node, in order, and the query's own where it is one
                n = np.minimum(ends[node] - begin[node], limit)
                line = np.repeat(np.arange(len(ok)), n)
                place = begin[node][line] + np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
                own = [ids[begin[c] : ends[c]] for c in node]
                own = np.array([(p := np.searchsorted(v, i)) >= limit and p < len(v) and v[p] == i for v, i in zip(own, q)], dtype=bool)
                out["query"] += [q[line], q[own]]
                out["id"] += [ids[place], q[own]]
                # what a query cost in the shard stands beside its first row there
                paid = np.zeros(len(line), dtype=np.int64)
                if k == 0:
                    paid[np.cumsum(n) - n] = cost[ok]
                out["cost"] += [paid, np.zeros(own.sum(), dtype=np.int64)]
        return pa.table({c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in out.items()})

    return run


class GraphIndex(VectorIndex):
    """A written proximity graph, kept up to date from a journal of changes.

    Rows of one vector are one node of their shard, so copies don't crowd out others.

    ``sync`` builds the shards that hold changed ids; another provider or size of
    vectors, a journal that starts anew, a broken checkpoint, or shards that have
    grown to twice their size lead to a rebuild.  Vectors must be finite and not
    zero; ids are whole numbers, each once.
    """

    SHARD = SHARD

    def _of(self, shards: int):
        return F.pmod(F.xxhash64(F.col("id").cast("long")), F.lit(shards)).cast("int")

    def _parts(self) -> list[str]:
        had = self._checkpoint()
        return had["parts"] if had else []

    def sync(self, vectors: DataFrame, journal: DataFrame) -> dict:
        """Bring the index up to the journal (seq, id): rebuild, shards built, checkpoint."""
        seq = journal.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        had = self._checkpoint()
        n = vectors.count()
        shards = had["shards"] if had else 0
        rebuild = not had or had["seq"] > seq or n > 2 * self.SHARD * shards or len(had["parts"]) >= self.MOST_PARTS
        if not rebuild and had["seq"] == seq:
            return {"rebuild": False, "built": 0, "checkpoint": seq}
        if rebuild:
            shards = max(1, -(-n // self.SHARD))
            parts, built = [self._build(vectors, shards, seq)], shards
        else:
            ids = journal.filter(F.col("seq") > had["seq"]).select(F.col("id").cast("long").alias("id"))
            touched = durable(ids.select(self._of(shards).alias("shard")).distinct(), "touched")
            own = vectors.withColumn("shard", self._of(shards)).join(touched, "shard", "left_semi")
            # a shard that lost all rows is known by the list of those built again
            touched_at = f"{self.root}/touched-{seq}"
            touched.coalesce(1).write.mode("overwrite").parquet(touched_at)
            parts, built = [*had["parts"], f"{self._build(own, shards, seq)}|{touched_at}"], touched.count()
            release(touched)
        state = self.spark.createDataFrame([(self.key, seq, parts, shards)], "key string, seq long, parts array<string>, shards int")
        state.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/checkpoint")
        return {"rebuild": rebuild, "built": built, "checkpoint": seq}

    def _build(self, vectors: DataFrame, shards: int, seq: int) -> str:
        folder = f"{self.root}/graph-{shards}-{seq}"
        own = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).withColumn("shard", self._of(shards))
        own.groupBy("shard").applyInArrow(_built(self.dims), _SHARD).write.mode("overwrite").parquet(folder)
        return folder

    def table(self) -> DataFrame:
        """The shards as last built."""
        first, *later = self._parts() or [None]
        if first is None:
            raise RuntimeError("the index must be synced first")
        read = self.spark.read.parquet
        out = read(first)
        for part in later:
            folder, touched = part.split("|")
            out = out.join(read(touched), "shard", "left_anti").unionByName(self.spark.read.schema(_SHARD).parquet(folder))
        return out

    def candidates(self, queries: DataFrame, limit: int, beam: int = BEAM) -> DataFrame:
        """(query, id, cost): the best of each shard, searched with its own beam or a wider
        one, of a vector's rows the first by id and the query's own; ``cost``, the likenesses computed for a query in the shard,
        stands beside one of its rows there."""
        had = self._checkpoint()
        n = queries.count()
        blocks = max(1, -(-n // QUERIES))
        block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")
        asked = queries.select(F.col("id").cast("long").alias("query"), F.col("embedding").cast("array<double>").alias("embedding")).withColumn("block", block)
        asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(had["shards"] - 1))))
        shards = self.table().withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        keys = ("shard", "block")
        return shards.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_searched(self.dims, max(beam, limit), limit), "query long, id long, cost long")


def nearest_graph(index: GraphIndex, vectors: DataFrame, queries: DataFrame, limit: int, beam: int = BEAM, own_first: bool = False) -> DataFrame:
    """(query, id, score, rank, cost): the best rows of all shards, scored exactly;
    ``cost`` is what the query's search computed over all shards.  Of equal rows the
    first by id comes first, with ``own_first`` the query's own row before it."""
    found = index.candidates(queries, limit, beam)
    found = found.withColumn("cost", F.sum("cost").over(W.partitionBy("query")))
    asked = queries.select(F.col("id").cast("long").alias("query"), F.col("embedding").alias("q"))
    scored = vectors.select("id", "embedding").join(found, "id").join(asked, "query").select("query", "id", cosine(F.col("embedding"), F.col("q")).alias("score"), "cost")
    ties = [F.col("id") != F.col("query"), F.col("id")] if own_first else [F.col("id")]
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc(F.round("score", 12)), *ties))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit)

