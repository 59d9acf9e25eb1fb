"""The entity graph: lineage, co-mentions, aggregates, neighbourhoods, paths."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import entities
from ..storage import durable


# Facts about the user: type, length that a value must exceed, patterns.
FACTS = (
    ("person", 2, (r"(?:me llamo|mi nombre es|soy)\s+([A-Za-záéíóúñÁÉÍÓÚÑ]+)", r"(?:llámame|call me)\s+([A-Za-záéíóúñÁÉÍÓÚÑ]+)", r"my name is\s+([A-Za-z]+)")),
    ("project", 2, (r"(?:trabajo en|working on|proyecto)\s+([A-Z][a-zA-Z\s]+)", r"(?:estoy construyendo|building)\s+([A-Z][a-zA-Z\s]+)")),
    ("technology", 0, (r"(?:uso|using|trabajo con)\s+(n8n|React|Python|JavaScript|Node|AI|GPT|Neo4j|Redis)",)),
    ("preference", 3, (r"(?:prefiero|i prefer|me gusta)\s+([^\.]+)", r"(?:no me gusta|i don't like)\s+([^\.]+)")),
)


def facts(messages: DataFrame, text_col: str = "content") -> DataFrame:
    """``messages`` with type and value: one row for each match of a fact's pattern."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    found = [F.transform(F.regexp_extract_all(t, F.lit("(?i)" + p), F.lit(1)), _valued(kind, least)) for kind, least, patterns in FACTS for p in patterns]
    each = messages.withColumn("__f", F.explode(F.flatten(F.array(*found))))
    return each.filter(F.char_length("__f.value") > F.col("__f.least")).select(*messages.columns, "__f.type", "__f.value")


def _valued(kind: str, least: int):
    return lambda v: F.struct(F.lit(kind).alias("type"), F.regexp_replace(v, r"^\s+|\s+$", "").alias("value"), F.lit(least).alias("least"))


def plain_entities(messages: DataFrame, tech: tuple[str, ...], text_col: str = "content") -> DataFrame:
    """(name, type, mentions) by the first rules: capitalised words, counted each time,
    and keywords within a text, counted once."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    people = messages.select(F.explode(F.regexp_extract_all(t, F.lit(r"\b([A-Z][a-z]+)\b"), F.lit(1))).alias("name")).groupBy("name").agg(F.count("*").alias("mentions"))
    held = messages.agg(*[F.max(F.lower(t).contains(w)).alias(w) for w in tech])
    words = held.select(F.explode(F.array(*[F.when(F.col(f"`{w}`"), F.lit(w)) for w in tech])).alias("name")).filter("name IS NOT NULL")
    return people.select("name", F.lit("person").alias("type"), "mentions").unionByName(words.select("name", F.lit("tech").alias("type"), F.lit(1).cast("long").alias("mentions")))


def entity_support(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """(episode, name, type): one row per entity of an episode."""
    # an inner explode would ask for a filled array first, and extract the entities twice
    return docs.select(F.col("id").alias("episode"), F.explode_outer(entities(F.col(text_col))).alias("e")).filter("e IS NOT NULL").select("episode", "e.name", "e.type")


def entity_counts(support: DataFrame) -> DataFrame:
    """(name, type, mentions): mentions are supporting episodes; the type is that of
    the least episode."""
    return support.groupBy("name").agg(F.min_by("type", "episode").alias("type"), F.count_distinct("episode").alias("mentions"))


def comentions(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """(episode, source, target): pairs of an episode's entities, in order of appearance.

    Each entity is a row with its place; pairs come out one by one, so no text's
    pairs are ever held at once.
    """
    names = F.transform(entities(F.col(text_col)), lambda e: e["name"])
    each = docs.select(F.col("id").alias("episode"), names.alias("n"))
    # outer, and no filter before it: either would extract the entities again
    first = each.select("episode", "n", F.posexplode_outer("n").alias("i", "source"))
    rest = F.explode(F.expr("slice(n, i + 2, size(n))"))
    return first.filter("i + 1 < size(n)").select("episode", "source", rest.alias("target"))


def linked_counts(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """(name, mentions, linked): supporting episodes, and whether one of them names
    another, so that the name stands in an edge.  Each text is met once, no edge is made."""
    names = F.transform(entities(F.col(text_col)), lambda e: e["name"])
    each = docs.select(F.col("id").alias("episode"), names.alias("n"))
    # outer, and no filter before it, as in comentions
    each = each.select("episode", (F.size("n") > 1).alias("linked"), F.explode_outer("n").alias("name")).filter("name IS NOT NULL")
    return each.groupBy("name").agg(F.count_distinct("episode").alias("mentions"), F.max("linked").alias("linked"))


#: Pairs that a piece of a text makes at most, that a task sorts at a time, and that a
#: bucket of ``graph_size`` gets, about.
PIECE, PAIRS = 1 << 20, 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _pieces(n, piece: int):
    """How many pieces hold the pairs of n names; sources go to them in turn."""
    return F.greatest(F.lit(1), F.ceil(n * (n - 1) / 2 / piece)).cast("int")


def _piece_pairs(n: int, piece: int, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of the pairs of one piece of n names."""
    i = np.arange(piece, n, pieces)
    later = n - 1 - i
    x = np.repeat(i, later)
    return x, x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later) - later, later)


def _each_once(held: list[np.ndarray]) -> np.ndarray:
    """The distinct numbers, in order; np.unique would hash them, which is far dearer."""
    x = np.concatenate(held)
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])]


def _pair_keys(width: int, bits: int):
    """Distinct pairs of some texts by bucket, as sorted numbers; a number is one pair's."""

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        x = _each_once(held)
        ends = np.append(np.searchsorted(x, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(x)) if bits else np.array([len(x)])
        begin = np.append(0, ends[:-1])
        some = np.flatnonzero(ends > begin)
        return pa.RecordBatch.from_arrays([pa.array(some, type=pa.int32()), pa.array([x[begin[k] : ends[k]].tobytes() for k in some], type=pa.binary())], names=["bucket", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            lists = batch.column(0)
            ids, ends = lists.flatten().to_numpy().astype(np.uint64), np.cumsum(pc.list_value_length(lists).to_numpy())
            for end, size, piece, pieces in zip(ends, pc.list_value_length(lists).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()):
                own = np.sort(ids[end - size : end])
                i, j = _piece_pairs(size, piece, pieces)
                x = (own[i] * np.uint64(width) + own[j]) * _ODD
                # both steps can be undone, so different pairs stay different
                x ^= x >> np.uint64(32)
                held.append(x * _ODD)
                n += len(x)
                if n >= PAIRS:
                    yield rows(held)
                    held, n = [], 0
        if n:
            yield rows(held)

    return run


def _distinct(key: tuple, table: pa.Table) -> pa.Table:
    keys = _each_once([np.frombuffer(b, np.uint64) for b in table["keys"].to_pylist()])
    return pa.table({"n": pa.array([len(keys)], type=pa.int64())})


def _numbered(docs: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame, int, int, int]:
    """Written: (ids, pieces), the numbered names of each text of two or more in order of
    appearance, and (name, id); names in all, a bound of ids, and pairs in all."""
    names = F.transform(entities(F.col(text_col)), lambda e: e["name"])
    lists = docs.select(F.monotonically_increasing_id().alias("row"), names.alias("n"))
    each = durable(lists.select("row", F.posexplode_outer("n").alias("place", "name")).filter("name IS NOT NULL"), "names")
    nodes = durable(each.select("name").distinct().withColumn("m", F.monotonically_increasing_id()), "nodes")
    part, place = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    found = nodes.agg(F.count("*").alias("n"), F.coalesce(F.max(part), F.lit(0)).alias("parts"), F.coalesce(F.max(place), F.lit(0)).alias("places")).first()
    across = found["places"] + 1
    width = (found["parts"] + 1) * across
    if width >= 1 << 31:
        raise ValueError("pairs of so many names don't fit a number of 64 bits")
    nodes = nodes.select("name", (part * across + place).alias("id"))
    coded = each.join(nodes, "name").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "id")))["id"].alias("ids"))
    n = F.size("ids").cast("long")
    coded = durable(coded.filter(n > 1).select("ids", _pieces(n, PIECE).alias("pieces")), "coded")
    pairs = coded.agg(F.coalesce(F.sum(n * (n - 1) / 2), F.lit(0.0))).first()[0]
    return coded, nodes, found["n"], width, int(pairs)


def _dealt(coded: DataFrame, tasks: int) -> DataFrame:
    """A row for each piece of a text's pairs, dealt over so many tasks at least."""
    pieces = coded.select("ids", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "pieces")
    return pieces.repartition(max(coded.sparkSession.sparkContext.defaultParallelism, tasks))


def graph_size(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """(entities, relationships), one row: names, and pairs of names that share a text.

    Names get whole numbers, and a pair is one number; tasks sort the pairs of some texts
    and send them by bucket, packed, so that no pair is a row.
    """
    coded, _, n_names, width, pairs = _numbered(docs, text_col)
    bits = max(0, int(np.ceil(np.log2(max(1, pairs / PAIRS)))))
    met = _dealt(coded, 1 << bits).mapInArrow(_pair_keys(width, bits), "bucket int, keys binary")
    return met.groupBy("bucket").applyInArrow(_distinct, "n long").agg(F.lit(n_names).cast("long").alias("entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("relationships"))


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1]))


def _tile_keys(tiles: int, across: int):
    """Ordered pairs of some texts by tile of the table of all names by all names, as
    sorted numbers within the tile, with how often each was met."""

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(held)
        x.sort()
        begin = _runs(x)
        x, met = x[begin], np.diff(begin, append=len(x))
        met = met.astype("u1" if met.max() < 256 else "<i8")
        ends = np.searchsorted(x, np.arange(1, tiles * tiles + 1) * (across * across))
        start = np.append(0, ends[:-1])
        some = np.flatnonzero(ends > start)
        cells = ([int(t) for t in some], [(x[start[t] : ends[t]] - t * across * across).tobytes() for t in some], [met[start[t] : ends[t]].tobytes() for t in some])
        return pa.RecordBatch.from_arrays([pa.array(c, type=kind) for c, kind in zip(cells, (pa.int32(), pa.binary(), pa.binary()))], names=["tile", "keys", "met"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            lists = batch.column(0)
            sizes = pc.list_value_length(lists).to_numpy()
            ids, ends = lists.flatten().to_numpy(), np.cumsum(sizes)
            block, own = ids % tiles, ids // tiles
            # a pair's number is the sum of one for either end
            left, right = (block * (tiles * across) + own) * across, block * (across * across) + own
            for end, size, piece, pieces in zip(ends, sizes, batch.column(1).to_numpy(), batch.column(2).to_numpy()):
                i, j = _piece_pairs(size, piece, pieces)
                held.append(left[end - size + i] + right[end - size + j])
                n += len(i)
                if n >= PAIRS:
                    yield rows(held)
                    held, n = [], 0
        if n:
            yield rows(held)

    return run


def _name_blocks(tiles: int):
    """Names of each block of ids, packed.  Ids are dealt to blocks in turn, as names
    met first, which are the frequent ones, have ids next to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1).to_numpy()
            for k in np.unique(ids % tiles):
                own = np.flatnonzero(ids % tiles == k)
                cells = (pa.array([k], type=pa.int32()), pa.array([(ids[own] // tiles).tobytes()], type=pa.binary()), pa.array([batch.column(0).take(pa.array(own)).to_pylist()], type=pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays([*cells], names=["block", "ids", "names"])

    return run


#: Edges of a batch that a task of ``whole_edges`` gives back.
_EDGES = 1 << 17


def _named_edges(tiles: int, across: int):
    """Edges of one tile, by the names of its two blocks."""
    schema = pa.schema([("source", pa.string()), ("target", pa.string()), ("weight", pa.float64())])

    def counted(pairs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys = [np.frombuffer(b, "<i8") for b in pairs["keys"].to_pylist()]
        met = np.concatenate([np.frombuffer(b, "u1" if len(b) == len(k) else "<i8") for b, k in zip(pairs["met"].to_pylist(), keys)])
        x = np.concatenate(keys)
        order = np.argsort(x)
        x, met = x[order], met[order]
        begin = _runs(x)
        return x[begin], np.add.reduceat(met, begin, dtype=np.int64).astype(np.float64)

    # batch by batch, so that a tile's names are never held for all of its edges
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        pairs, named = table.filter(pc.is_valid(table["keys"])), table.filter(pc.is_valid(table["block"]))
        if not pairs.num_rows:
            return
        x, weight = counted(pairs)
        del table, pairs
        block, lists = named["block"].to_numpy(), named["names"].combine_chunks()

        def names_of(k: int):
            rows = np.flatnonzero(block == k)
            ids = np.concatenate([np.frombuffer(named["ids"][int(r)].as_py(), "<i8") for r in rows])
            place = np.zeros(across, dtype=np.int64)
            place[ids] = np.arange(len(ids))
            return lists.take(pa.array(rows)).flatten(), place

        tile = key[0].as_py()
        (left, left_at), (right, right_at) = names_of(tile // tiles), names_of(tile % tiles)
        for at in range(0, len(x), _EDGES):
            own = x[at : at + _EDGES]
            cells = [left.take(pa.array(left_at[own // across])), right.take(pa.array(right_at[own % across])), pa.array(weight[at : at + _EDGES])]
            yield pa.RecordBatch.from_arrays(cells, schema=schema)

    return run


def whole_edges(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """(source, target, weight): ``edge_weights`` of all ``comentions``.

    Names get whole numbers and stand in blocks; tasks count the pairs of some texts as
    numbers, and send them packed to the tile of their two blocks, which gets the blocks'
    names, too.  A pair becomes a row once, as an edge.
    """
    coded, nodes, _, width, pairs = _numbered(docs, text_col)
    tiles = max(1, int(np.ceil(np.sqrt(pairs / PAIRS))))
    across = -(-width // tiles)
    met = _dealt(coded, tiles * tiles).mapInArrow(_tile_keys(tiles, across), "tile int, keys binary, met binary")
    blocks = nodes.mapInArrow(_name_blocks(tiles), "block int, ids binary, names array<string>")
    every = F.sequence(F.lit(0), F.lit(tiles - 1))
    own = F.array_union(F.transform(every, lambda k: F.col("block") * tiles + k), F.transform(every, lambda k: k * tiles + F.col("block")))
    blocks = blocks.withColumn("tile", F.explode(own))
    both = met.unionByName(blocks, allowMissingColumns=True)
    return both.groupBy("tile").applyInArrow(_named_edges(tiles, across), "source string, target string, weight double")


def edge_weights(pairs: DataFrame) -> DataFrame:
    """(source, target, weight): each episode adds one."""
    return pairs.groupBy("source", "target").agg(F.count("*").cast("double").alias("weight"))


def retract(support: DataFrame, gone: DataFrame) -> DataFrame:
    """Support rows without those of forgotten episodes; aggregates follow."""
    return support.join(gone.select(F.col("id").alias("episode")).distinct(), "episode", "left_anti")


def neighbours(edges: DataFrame, name: str, limit: int) -> DataFrame:
    """Edges at either end of a name, heaviest first."""
    return edges.filter((F.col("source") == name) | (F.col("target") == name)).orderBy(F.desc("weight"), "source", "target").limit(limit)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("a").agg(F.count("*").alias("degree"))


#: Edges that a task of ``triangles`` holds, about; cells of its table, and wedges that
#: it looks up at a time.
TASK_EDGES, CELLS, WEDGES = 1 << 22, 1 << 25, 1 << 21


def _compact(n: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes held, in order, and the place of each node among them."""
    mark = np.zeros(n, dtype=bool)
    mark[held] = True
    return np.flatnonzero(mark), np.cumsum(mark) - 1


def _closed(n_nodes: int, uv: tuple, uw: tuple, vw: tuple) -> list[tuple[np.ndarray, np.ndarray]]:
    """(nodes, triangles) of the u, v and w with u < v < w, from the edges of each two,
    which are in order."""
    ws, w_place = _compact(n_nodes, vw[1])
    vs, v_place = _compact(n_nodes, vw[0])
    us, u_place = _compact(n_nodes, uv[0])
    in_w, in_v, in_u = (np.zeros(n_nodes, dtype=bool) for _ in range(3))
    in_w[ws], in_v[vs], in_u[us] = True, True, True
    w_of, v_of = w_place[vw[1]], v_place[vw[0]]
    ok = in_w[uw[1]] & in_u[uw[0]]
    keys = u_place[uw[0][ok]] * np.int64(len(ws)) + w_place[uw[1][ok]]
    if not len(keys):
        return []
    ends, w_at = np.searchsorted(keys, np.arange(1, len(us) + 1) * np.int64(len(ws))), keys % len(ws)
    # edges u, v by v, with the part of u's list that comes after v
    ok = in_v[uv[1]]
    u, v = u_place[uv[0][ok]], v_place[uv[1][ok]]
    begin = np.searchsorted(keys, u * np.int64(len(ws)) + (w_place + 1)[uv[1][ok]])
    n = ends[u] - begin
    o = np.argsort(v, kind="stable")
    o = o[n[o] > 0]
    u, v, begin, n = u[o], v[o], begin[o], n[o]
    tu, tv, tw = np.zeros(len(us), np.int64), np.zeros(len(vs), np.int64), np.zeros(len(ws), np.int64)
    lines = max(1, CELLS // len(ws))
    for a in range(0, len(vs), lines):
        e = slice(*np.searchsorted(v_of, [a, a + lines]))
        first, last = np.searchsorted(v, [a, a + lines])
        if first == last:
            continue
        linked = np.zeros((min(lines, len(vs) - a), len(ws)), dtype=bool)
        linked[v_of[e] - a, w_of[e]] = True
        linked, total = linked.ravel(), np.cumsum(n[first:last])
        while first < last:
            done = total[len(total) - (last - first)] - n[first]
            to = max(first + 1, first + np.searchsorted(total[len(total) - (last - first) :], done + WEDGES, side="right"))
            size = n[first:to]
            start = np.cumsum(size) - size
            w = w_at[np.repeat(begin[first:to] - start, size) + np.arange(size.sum())]
            hit = linked[np.repeat((v[first:to] - a) * np.int64(len(ws)), size) + w]
            per = np.add.reduceat(hit, start, dtype=np.int64)
            tu += np.bincount(u[first:to], per, len(us)).astype(np.int64)
            tv += np.bincount(v[first:to], per, len(vs)).astype(np.int64)
            tw += np.bincount(w[hit], minlength=len(ws))
            first = to
    return [(us, tu), (vs, tv), (ws, tw)]


def _steps(x: np.ndarray) -> bytes:
    """Whole numbers as compressed steps from one to the next."""
    return pa.compress(np.diff(x, prepend=0).astype("<i8").tobytes(), codec="zstd", asbytes=True)


def _walked(held: bytes, n: int) -> np.ndarray:
    """The n numbers that ``_steps`` packed."""
    return np.cumsum(np.frombuffer(pa.decompress(held, n * 8, codec="zstd", asbytes=True), "<i8"))


def _counted(key: tuple, table: pa.Table) -> pa.Table:
    """(id, t) of one task: triangles whose ends have just its colours."""
    colours = tuple(int(c) for c in key[0].as_py().split())
    sizes = table["n"].to_numpy()
    u, v = (np.concatenate([_walked(b.as_py(), n) for b, n in zip(table[c], sizes)]) for c in ("u", "v"))
    of = np.repeat(np.arange(table.num_rows), sizes)
    ids = np.unique(np.concatenate([u, v]))
    # in order of u, then v
    edges = np.searchsorted(ids, u) * np.int64(len(ids)) + np.searchsorted(ids, v)
    order = np.argsort(edges)
    edges, pair = edges[order], (table["cu"].to_numpy() * np.int64(1 << 20) + table["cv"].to_numpy())[of[order]]
    u, v = edges // len(ids), edges % len(ids)
    own = {p: (u[k], v[k]) for p in {(a, b) for a in colours for b in colours} if len(k := np.flatnonzero(pair == p[0] * (1 << 20) + p[1]))}
    t = np.zeros(len(ids), np.int64)
    for x, y, z in sorted(set(permutations(colours))):
        if (x, y) in own and (x, z) in own and (y, z) in own:
            for nodes, found in _closed(len(ids), own[x, y], own[x, z], own[y, z]):
                t[nodes] += found
    return pa.table({"id": ids[t > 0], "t": t[t > 0]})


_EDGE_ROWS = "cu int, cv int, n long, u binary, v binary"


def _edge_row(cu: int, cv: int, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    """Some edges of two colours as one row, in order, so that they take few bytes."""
    order = np.lexsort((v, u))
    cells = (pa.array([x], type=kind) for x, kind in ((cu, pa.int32()), (cv, pa.int32()), (len(u), pa.int64()), (_steps(u[order]), pa.binary()), (_steps(v[order]), pa.binary())))
    return pa.RecordBatch.from_arrays([*cells], names=["cu", "cv", "n", "u", "v"])


def _packed(colours: int):
    """Edges of each two colours as one row, a million edges at a time."""

    def rows(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        u, v, cu, cv = (t[c].to_numpy() for c in ("u", "v", "cu", "cv"))
        pair = cu * colours + cv
        order = np.argsort(pair, kind="stable")
        for k in np.split(order, np.flatnonzero(np.diff(pair[order])) + 1):
            yield _edge_row(cu[k[0]], cv[k[0]], u[k], v[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= 1 << 20:
                yield from rows(held)
                held, n = [], 0
        if held:
            yield from rows(held)

    return run


def triangles(edges: DataFrame, colours: int) -> DataFrame:
    """(id, t): triangles through a node, 0 left out.

    ``edges``: (u, v) of whole numbers, u < v, each once, u with no more links than v.
    Nodes have one of ``colours`` by a hash of the id.  A task gets the edges within
    three colours and counts triangles that have just these; wedges never leave it, an
    edge goes to ``colours`` tasks.
    """
    colour = lambda c: F.pmod(F.xxhash64(c), F.lit(colours)).cast("int")
    e = edges.select("u", "v", colour("u").alias("cu"), colour("v").alias("cv")).mapInArrow(_packed(colours), _EDGE_ROWS)
    return _triangles_of(e, colours)


def _triangles_of(packed: DataFrame, colours: int) -> DataFrame:
    """``triangles`` of packed edges, whatever gave their ends one of so many colours."""
    third = F.explode(F.sequence(F.lit(0), F.lit(colours - 1))).alias("c")
    e = packed.select("u", "v", "n", "cu", "cv", third).withColumn("task", F.array_join(F.array_sort(F.array("cu", "cv", "c")).cast("array<string>"), " "))
    return e.drop("c").groupBy("task").applyInArrow(_counted, "id long, t long").groupBy("id").agg(F.sum("t").alias("t"))


def clustering(edges: DataFrame) -> DataFrame:
    """(name, degree, clustering, clustering_normal): share of a node's neighbour
    pairs that are linked.  ``clustering`` divides ordered pairs by unordered
    ones, so it reaches 2; the normal one is half of it.

    Wedges start at the end of smaller degree, which bounds them by edges times
    the root of edges.  ``edges``: source, target; repeats count once.
    """
    once = durable(edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct(), "edges")
    ends = F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
    d = once.select(F.explode(ends).alias("name")).groupBy("name").agg(F.count("*").alias("degree"))
    # sorted in ranges, so ids follow degree and name
    nodes = durable(d.orderBy("degree", "name").withColumn("id", F.monotonically_increasing_id()), "nodes")
    of = lambda end, k: nodes.select(F.col("name").alias(end), F.col("id").alias(k))
    e = once.filter("a != b").join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
    e = durable(e, "links")
    colours = max(4, int(np.ceil(np.sqrt(6 * e.count() / TASK_EDGES))))
    return _shares(nodes.join(triangles(e, colours), "id", "left"))


def _shares(nodes: DataFrame) -> DataFrame:
    """``clustering`` from (name, degree, t)."""
    share = 2 * F.coalesce("t", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1) / 2)
    c = F.when(F.col("degree") < 2, 0.0).otherwise(share)
    return nodes.select("name", "degree", c.alias("clustering"), (c / 2).alias("clustering_normal"))


def _tile_edges(tiles: int, across: int):
    """The distinct pairs of a tile, and how many each name of its two blocks is in."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tile = key[0].as_py()
        x = _each_once([np.frombuffer(b, "<i8") for b in table["keys"].to_pylist()])
        if tile // tiles == tile % tiles:
            x = x[x // across != x % across]
        counts = (np.bincount(side, minlength=across) for side in (x // across, x % across))
        cells = ((tile, pa.int32()), (len(x), pa.int64()), *((_steps(c), pa.binary()) for c in (x, *counts)))
        return pa.table([pa.array([c], type=kind) for c, kind in cells], names=["tile", "n", "keys", "left", "right"])

    return run


def _block_degrees(tiles: int, across: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(_walked(b.as_py(), across) for b in table["counts"])
        own = np.flatnonzero(total)
        return pa.table({"id": pa.array(own * tiles + key[0].as_py(), type=pa.int64()), "degree": pa.array(total[own], type=pa.int64())})

    return run


def _block_ranks(tiles: int, across: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        ranks = np.zeros(across, dtype=np.int64)
        ranks[table["id"].to_numpy() // tiles] = table["rank"].to_numpy()
        return pa.table({"block": pa.array([key[0].as_py()], type=pa.int32()), "ranks": pa.array([_steps(ranks)], type=pa.binary())})

    return run


def _tile_ranks(tiles: int, across: int):
    """Edges of a tile by the ranks of their ends; a name's colour is its block."""
    schema = pa.schema([("cu", pa.int32()), ("cv", pa.int32()), ("n", pa.int64()), ("u", pa.binary()), ("v", pa.binary())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        tile = key[0].as_py()
        ranks = {k: _walked(b, across) for k, b in zip(table["block"].to_pylist(), table["ranks"].to_pylist()) if b is not None}
        out = []
        for n, keys in zip(table["n"].to_pylist(), table["keys"].to_pylist()):
            if not n:
                continue
            x = _walked(keys, n)
            left, right = ranks[tile // tiles][x // across], ranks[tile % tiles][x % across]
            for cu, cv, u, v in ((tile // tiles, tile % tiles, left, right), (tile % tiles, tile // tiles, right, left)):
                own = np.flatnonzero(u < v)
                out += [_edge_row(cu, cv, u[k], v[k]) for k in np.split(own, range(1 << 20, len(own), 1 << 20)) if len(k)]
        return pa.Table.from_batches(out, schema=schema)

    return run


def clustering_of(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """``clustering`` of all ``comentions``.

    Names get whole numbers and stand in blocks; the pairs of some texts go packed to the
    tile of their two blocks, which gives each edge once.  Edges stay packed, by the rank
    of their ends, until triangles are counted; a block is a colour.
    """
    coded, nodes, _, width, pairs = _numbered(docs, text_col)
    tiles = max(4, int(np.ceil(np.sqrt(6 * pairs / TASK_EDGES))))
    across = -(-width // tiles)
    # in order of their numbers, so that a pair is one number whichever name comes first
    met = _dealt(coded.withColumn("ids", F.array_sort("ids")), tiles * tiles).mapInArrow(_tile_keys(tiles, across), "tile int, keys binary, met binary")
    edges = durable(met.select("tile", "keys").groupBy("tile").applyInArrow(_tile_edges(tiles, across), "tile int, n long, keys binary, left binary, right binary"), "edges")
    block = lambda c: F.expr(f"CAST(tile {c} {tiles} AS INT)").alias("block")
    ends = edges.select(block("div"), F.col("left").alias("counts")).unionByName(edges.select(block("%"), F.col("right").alias("counts")))
    degrees = ends.groupBy("block").applyInArrow(_block_degrees(tiles, across), "id long, degree long")
    # sorted in ranges, so ranks follow degree and id
    ranked = durable(degrees.orderBy("degree", "id").withColumn("m", F.monotonically_increasing_id()), "ranks")
    part, place = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    most = ranked.agg(F.coalesce(F.max(place), F.lit(0))).first()[0] + 1
    ranked = ranked.select("id", "degree", (part * most + place).alias("rank"))
    blocks = ranked.withColumn("block", (F.col("id") % tiles).cast("int")).groupBy("block").applyInArrow(_block_ranks(tiles, across), "block int, ranks binary")
    every = F.sequence(F.lit(0), F.lit(tiles - 1))
    own = F.array_union(F.transform(every, lambda k: F.col("block") * tiles + k), F.transform(every, lambda k: k * tiles + F.col("block")))
    both = edges.select("tile", "n", "keys").unionByName(blocks.withColumn("tile", F.explode(own)), allowMissingColumns=True)
    packed = durable(both.groupBy("tile").applyInArrow(_tile_ranks(tiles, across), _EDGE_ROWS), "links")
    tri = _triangles_of(packed, tiles).withColumnRenamed("id", "rank")
    return _shares(ranked.join(nodes, "id").join(tri, "rank", "left"))


def hops(edges: DataFrame, start: str, most: int) -> DataFrame:
    """(name, hops): least number of edges from ``start``, up to ``most``.

    A frontier join a step; nodes already reached are dropped each time.  Each
    frontier is written, so a step costs one shuffle of it and of the edges.
    """
    return reduce(lambda a, b: a.unionByName(b), _fronts(edges, start, most)).select("name", "hops")


def named(docs: DataFrame, text_col: str = "content") -> DataFrame:
    """(episode, row, place, name), written: the entities of each text of two or more."""
    names = F.transform(entities(F.col(text_col)), lambda e: e["name"])
    lists = docs.select(F.col("id").alias("episode"), F.monotonically_increasing_id().alias("row"), names.alias("n"))
    each = lists.select("episode", "row", F.size("n").alias("size"), F.posexplode_outer("n").alias("place", "name"))
    return durable(each.filter("size > 1").drop("size"), "names")


def hops_together(names: DataFrame, start: str, most: int) -> DataFrame:
    """(name, hops) as ``hops`` over all co-mentions, from what ``named`` gives: names are
    neighbours where they share a text, so a step goes to the texts of its front and
    back to their names, and no edge is made."""
    own = names.select("row", "name")
    front = names.sparkSession.createDataFrame([(start, 0)], "name string, hops int")
    out = seen = front
    for step in range(1, most + 1):
        met = own.join(front.select("name"), "name", "left_semi").select("row").distinct()
        new = own.join(met, "row", "left_semi").select("name").distinct().join(seen.select("name"), "name", "left_anti")
        before, front = front, durable(new.select("name", F.lit(step).alias("hops")), "front")
        if front.isEmpty():
            break
        out = out.unionByName(front)
        # what lies two steps back can't be reached anew
        seen = front.select("name").unionByName(before.select("name"))
    return out


#: Most mentioned names among which ``heaviest`` looks for edges first.
FIRST_NAMES = 256


def heaviest(names: DataFrame, limit: int) -> DataFrame:
    """(source, target, weight): the heaviest co-mentions, then by source and target, from
    what ``named`` gives.

    An edge weighs no more than either name's mentions.  So many edges among the most
    mentioned names give a weight that the last one reaches; only names mentioned as
    often can be in a heavier or equal one, and only their pairs are made.
    """
    mentions = durable(names.groupBy("name").agg(F.count("*").alias("mentions")), "mentions")

    def among(some: DataFrame) -> DataFrame:
        kept = names.join(some.select("name"), "name", "left_semi").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("n"))
        first = kept.select("n", F.posexplode("n").alias("i", "x"))
        pairs = first.select(F.col("x.name").alias("source"), F.explode(F.expr("slice(n, i + 2, size(n))")).alias("y"))
        return edge_weights(pairs.select("source", F.col("y.name").alias("target"))).orderBy(F.desc("weight"), "source", "target").limit(limit)

    found = among(mentions.orderBy(F.desc("mentions"), "name").limit(FIRST_NAMES)).agg(F.count("*").alias("n"), F.min("weight").alias("least")).first()
    least = found["least"] if found["n"] == limit else 0.0
    return among(mentions.filter(F.col("mentions") >= least))


def weakest(names: DataFrame, limit: int) -> DataFrame:
    """(source, target, weight): ``limit`` or more co-mentions, with the first of them by
    weight, source and target, from what ``named`` gives.

    Nothing weighs less than 1, so once the first sources by name have as many edges of
    that weight, none of a later source comes before.
    """
    each = names.select("name").distinct()
    some = FIRST_NAMES
    while True:
        first = each.orderBy("name").limit(some).agg(F.count("*").alias("n"), F.max("name").alias("last")).first()
        sources = names if first["n"] < some else names.filter(F.col("name") <= first["last"])
        left = sources.select("row", F.col("place").alias("i"), F.col("name").alias("source"))
        right = names.select("row", F.col("place").alias("j"), F.col("name").alias("target"))
        edges = edge_weights(left.join(right, "row").filter("i < j"))
        if first["n"] < some:
            return edges
        edges = durable(edges, "edges")
        if edges.filter("weight = 1").limit(limit).count() == limit:
            return edges
        some *= 16


def _fronts(edges: DataFrame, start: str, most: int | None, end: str | None = None) -> list[DataFrame]:
    """(name, hops, parent) of what is reached, a frame for each step; each from its
    least parent.  Steps end where nothing is new, at ``end``, or after ``most``."""
    e = durable(both_ways(edges), "edges")
    front = edges.sparkSession.createDataFrame([(start, 0, None)], "name string, hops int, parent string")
    seen, fronts = front.select("name"), [front]
    while most is None or len(fronts) <= most:
        new = front.join(e, front["name"] == e["a"]).groupBy(F.col("b").alias("name")).agg(F.min("a").alias("parent")).join(seen, "name", "left_anti")
        front = durable(new.select("name", F.lit(len(fronts)).alias("hops"), "parent"), "front")
        if front.isEmpty():
            break
        fronts.append(front)
        # what lies two steps back can't be reached anew
        seen = fronts[-1].select("name").unionByName(fronts[-2].select("name"))
        if end is not None and not front.filter(F.col("name") == end).isEmpty():
            break
    return fronts


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(step, name): the nodes of a shortest path of any length, from ``start`` on;
    none where ``end`` can't be reached.  Of equal paths the one whose nodes, from
    the end on, come first by name."""
    fronts = _fronts(edges, start, None, end) if start != end else _fronts(edges, start, 0)
    path, at = [], end
    for front in reversed(fronts):  # a lookup in each step's own table
        row = front.filter(F.col("name") == at).first()
        if row is None:
            break
        path.append((row["hops"], row["name"]))
        at = row["parent"]
    return edges.sparkSession.createDataFrame(path, "step int, name string")


def bridges(edges: DataFrame, below: float = 0.3, above: int = 3, limit: int = 10) -> DataFrame:
    """(name, clustering, degree): nodes of many links and little clustering."""
    own = clustering(edges).filter((F.col("clustering") < below) & (F.col("degree") > above))
    return own.select("name", "clustering", "degree").orderBy(F.desc("degree"), "name").limit(limit)


def accumulate(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """(name, type, mentions, first_seen, last_seen) after upserts: mentions add up; a
    known entity keeps its type and first time.

    Both sides hold these columns; incoming rows of one name all count, their
    first in time names a new entity.
    """
    both = store.withColumn("k", F.lit(0)).unionByName(incoming.withColumn("k", F.lit(1)))
    order = F.struct("k", "first_seen", "type")
    return both.groupBy("name").agg(F.min_by("type", order).alias("type"), F.sum("mentions").alias("mentions"), F.min_by("first_seen", order).alias("first_seen"), F.max("last_seen").alias("last_seen"))


def add_links(links: DataFrame, incoming: DataFrame) -> DataFrame:
    """(source, target, type, weight): weights of equal links add up."""
    return links.unionByName(incoming).groupBy("source", "target", "type").agg(F.sum("weight").alias("weight"))


def apply_episodes(support: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Support after replacing what the episodes of ``fresh`` gave, and the counts of
    the names touched, old and new; 0 for one that nothing supports any more.

    Both sides: episode, name, type.  A replay changes nothing.
    """
    ids = fresh.select("episode").distinct()
    after = support.join(ids, "episode", "left_anti").unionByName(fresh)
    touched = support.join(ids, "episode", "left_semi").select("name").union(fresh.select("name")).distinct()
    counts = after.join(touched, "name", "left_semi").groupBy("name").agg(F.count_distinct("episode").alias("mentions"))
    return after, touched.join(counts, "name", "left").select("name", F.coalesce("mentions", F.lit(0)).alias("mentions"))


def search_graph(names: DataFrame, messages: DataFrame, found: DataFrame) -> DataFrame:
    """(source, target, weight): an entity and those named in the messages found for
    it, by the sum of their similarities.

    ``found``: name, id, similarity (a few messages a name); ``messages``: id,
    content.
    """
    from .maintenance import mentions

    said = mentions(names, messages.join(found.select("id").distinct(), "id", "left_semi"))
    met = found.join(said.select(F.col("name").alias("target"), "id"), "id").filter("name != target")
    return met.groupBy(F.col("name").alias("source"), "target").agg(F.sum("similarity").alias("weight"))


def match(edges: DataFrame, nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """(kind, name, target, weight): links at a name that holds the query's first word
    of more than three letters, else nodes that hold it, by ``importance``."""
    long_ = [w for w in query.split() if len(w) > 3]
    term = (long_[0] if long_ else query[:20]).lower()
    held = lambda c: F.lower(c).contains(term)
    rels = edges.filter(held("source") | held("target")).orderBy(F.desc("weight"), "source", "target").limit(limit)
    rels = rels.select(F.lit("link").alias("kind"), F.col("source").alias("name"), "target", "weight")
    none = rels.agg(F.count("*").alias("n")).filter("n = 0")
    alone = nodes.filter(held("name")).orderBy(F.desc("importance"), "name").limit(limit).crossJoin(F.broadcast(none))
    return rels.unionByName(alone.select(F.lit("node").alias("kind"), "name", F.lit(None).cast("string").alias("target"), F.col("importance").cast("double").alias("weight")))


def associations(pairs: DataFrame, name: str) -> DataFrame:
    """(other, strength) of one name, strongest first; (a, b, amount) strengthen both ways."""
    both = pairs.select("a", "b", "amount").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "amount"))
    return both.filter(F.col("a") == name).groupBy(F.col("b").alias("other")).agg(F.sum("amount").alias("strength")).orderBy(F.desc(F.round("strength", 9)), "other")


def gaps(counts: DataFrame, edges: DataFrame, least: int, scanned: int | None, limit: int) -> DataFrame:
    """Questions about entities with no neighbour or few mentions, most mentioned
    first; ``scanned`` keeps to that many of the most mentioned."""
    linked = edges.select("source").union(edges.select("target")).distinct().withColumnRenamed("source", "name").withColumn("linked", F.lit(True))
    return open_questions(counts.join(linked, "name", "left"), least, scanned, limit)


def open_questions(counts: DataFrame, least: int, scanned: int | None, limit: int) -> DataFrame:
    """``gaps`` from (name, mentions, linked), as ``linked_counts`` gives them."""
    top = counts if scanned is None else counts.orderBy(F.desc("mentions"), "name").limit(scanned)
    open_ = top.filter(~F.coalesce("linked", F.lit(False)) | (F.col("mentions") < least))
    out = open_.orderBy(F.desc("mentions"), "name").limit(limit)
    return out.select("name", "mentions", F.concat(F.lit("What more do we know about '"), "name", F.lit("', and how does it relate to other topics?")).alias("question"))


def weak_ties(edges: DataFrame, below: float, limit: int) -> DataFrame:
    """Edges lighter than ``below``, by potential 1 - weight."""
    return edges.filter(F.col("weight") < below).withColumn("potential", 1 - F.col("weight")).orderBy(F.desc("potential"), "source", "target").limit(limit)


#: Records of a block of ``word_pairs``, about, and blocks of a stripe; words that stand in
#: one of so many cells of a product of two blocks or more are multiplied, the others'
#: meetings are listed so many at a time; pairs of a batch that is given back.
BLOCK_ROWS, STRIPE, DENSE, MEETINGS, BATCH = 1024, 64, 150, 1 << 22, 1 << 17


def _postings(n: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Places of the postings of some words, one word after the other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - begin, n)


def _products(x: tuple, y: tuple, lines: int, columns: int) -> np.ndarray:
    """Common words of each row of x with each of y, from their (words, rows of each word
    in all, rows word by word)."""
    out = np.zeros(lines * columns, dtype=np.int64)
    words, at_x, at_y = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(words):
        return out.reshape(lines, columns)
    nx, ny = x[1][at_x], y[1][at_y]
    bx, by = (np.cumsum(side[1])[at] - n for side, at, n in ((x, at_x, nx), (y, at_y, ny)))
    heavy = nx * ny * DENSE > lines * columns
    some = np.flatnonzero(heavy)
    for first in range(0, len(some), BLOCK_ROWS):
        k = some[first : first + BLOCK_ROWS]
        both = []
        for rows, n, begin, height in ((x[2], nx[k], bx[k], lines), (y[2], ny[k], by[k], columns)):
            cell = rows[_postings(n, begin)].astype(np.int64) * len(k) + np.repeat(np.arange(len(k)), n)
            both.append(np.bincount(cell, minlength=height * len(k)).reshape(height, len(k)))
        # whole numbers below 2^24 are exact in four bytes
        kind = np.float32 if len(k) * both[0].max() * both[1].max() < 1 << 24 else np.float64
        out += (both[0].astype(kind) @ both[1].astype(kind).T).astype(np.int64).ravel()
    k = np.flatnonzero(~heavy)
    row, size, start = x[2][_postings(nx[k], bx[k])].astype(np.int64), np.repeat(ny[k], nx[k]), np.repeat(by[k], nx[k])
    total, at = np.cumsum(size), 0
    while at < len(row):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + MEETINGS, side="right")))
        met = y[2][_postings(size[at:to], start[at:to])]
        out += np.bincount(np.repeat(row[at:to] * columns, size[at:to]) + met, minlength=len(out))
        at = to
    return out.reshape(lines, columns)


def _small(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes of two or four, compressed."""
    return pa.compress(x.astype("<u2" if x.max(initial=0) < 1 << 16 else "<u4").tobytes(), codec="zstd", asbytes=True)


def _large(held: bytes, n: int, wide: bool) -> np.ndarray:
    """What ``_small`` made of n numbers, ``wide`` if they took four bytes."""
    return np.frombuffer(pa.decompress(held, n * (4 if wide else 2), codec="zstd", asbytes=True), "<u4" if wide else "<u2").astype(np.int64)


def _inverted(key: tuple, table: pa.Table) -> pa.Table:
    """One block of records: their ids in order, and the rows that hold each word, as
    steps from one to the next."""
    ids = table["id"].combine_chunks()
    once = ids.unique()
    once = once.take(pc.sort_indices(once))
    lists = table["w"].combine_chunks()
    row = np.repeat(pc.index_in(ids, once).to_numpy(), pc.list_value_length(lists).to_numpy())
    word = lists.flatten().to_numpy()
    # by word, then by row
    order = np.lexsort((row, word))
    word, row = word[order], row[order]
    begin = _runs(word) if len(word) else np.empty(0, np.int64)
    n = np.diff(begin, append=len(word))
    step = np.diff(row, prepend=0)
    step[begin] = row[begin]
    wide = [bool(x.max(initial=0) >= 1 << 16) for x in (n, step)]
    cells = (([key[0].as_py()], pa.int32()), ([word[begin].astype("<i8").tobytes()], pa.binary()), ([_small(n)], pa.binary()), ([_small(step)], pa.binary()), ([len(word)], pa.int64()), ([wide], pa.list_(pa.bool_())))
    return pa.table([pa.ListArray.from_arrays([0, len(once)], once), *(pa.array(v, type=kind) for v, kind in cells)], names=["ids", "block", "words", "n", "steps", "size", "wide"])


def _common(least: int, stripes: int):
    """Pairs of two stripes (or within one) with more than ``least`` common words, two
    blocks at a time."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        lists = table["ids"].combine_chunks()
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        ids = lists.flatten()
        order = pc.sort_indices(ids).to_numpy()
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        ids, places = ids.take(pa.array(order)), np.split(place, ends[:-1])

        def side(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            r = {c: table[c][int(k)].as_py() for c in ("words", "n", "steps", "size", "wide")}
            words = np.frombuffer(r["words"], "<i8")
            n = _large(r["n"], len(words), r["wide"][0])
            rows = np.cumsum(_large(r["steps"], r["size"], r["wide"][1]))
            # sums of all words before are taken off
            begin = np.cumsum(n) - n
            rows -= np.repeat(np.append(0, rows[begin[1:] - 1]), n)
            return words, n, rows.astype(np.int32)

        stripe = table["block"].to_numpy() % stripes
        one, two = (np.flatnonzero(stripe == k.as_py()) for k in key)
        right_sides = {k: side(k) for k in two}
        for left in one:
            x = side(left)
            for right in two if key[0] != key[1] else one[one >= left]:
                n = _products(x, right_sides[right], len(places[left]), len(places[right]))
                i, j = np.nonzero(np.triu(n > least, 1) if left == right else n > least)
                common, i, j = n[i, j], places[left][i], places[right][j]
                for at in range(0, len(i), BATCH):
                    p, q = i[at : at + BATCH], j[at : at + BATCH]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.minimum(p, q))), ids.take(pa.array(np.maximum(p, q))), pa.array(common[at : at + BATCH])], names=["a", "b", "common"])

    return run


def _word_codes(t: DataFrame) -> DataFrame:
    """(id, w) with words as whole numbers, hashes by a seed for which no two are one."""
    own, seed = durable(t.select(F.explode("w").alias("w")).distinct(), "words"), 0
    while True:
        n = own.agg(F.count("*").alias("words"), F.count_distinct(F.xxhash64("w", F.lit(seed))).alias("codes")).first()
        if n["words"] == n["codes"]:
            return t.select("id", F.transform("w", lambda w: F.xxhash64(w, F.lit(seed))).alias("w"))
        seed += 1


def _all_word_pairs(docs: DataFrame, least: int, share: int) -> DataFrame:
    """(a, b, common) over all records, from (id, w), w the words of a record.

    Records stand in blocks, packed as the rows of each word; blocks stand in stripes.  A
    task gets two stripes and counts the common words of each two of their blocks as the
    product of their (record, word) matrices, so that meetings of words are no rows, a task
    holds two stripes whatever the corpus, and a block is sent once for each stripe.  Pairs
    themselves grow with the square of the records.
    """
    held = durable(_word_codes(docs.filter("id IS NOT NULL AND size(w) > 0")), "coded")
    blocks = max(1, -(-held.count() // share))
    kind = held.schema["id"].dataType.simpleString()
    packed = held.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition(min(blocks, 2048), "block").groupBy("block")
    packed = durable(packed.applyInArrow(_inverted, f"ids array<{kind}>, block int, words binary, n binary, steps binary, size long, wide array<boolean>"), "blocks")
    # three tasks a core at least, where there are as many blocks
    few = int(np.ceil(np.sqrt(6 * docs.sparkSession.sparkContext.defaultParallelism)))
    stripes = min(blocks, max(few, -(-blocks // STRIPE)))
    own, other = F.pmod("block", F.lit(stripes)), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("other")
    met = packed.select("*", own.alias("own"), other).withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).drop("own", "other")
    # so many tasks as there is work for, not as the rows shuffled would ask for
    met = met.repartition(min(stripes * (stripes + 1) // 2, 2048), "x", "y")
    return met.groupBy("x", "y").applyInArrow(_common(least, stripes), f"a {kind}, b {kind}, common long")


def word_pairs(docs: DataFrame, least: int, within: str | None = None, text_col: str = "content", share: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, common, strength): episodes with more than ``least`` common words, of
    one session if ``within`` names it; strength is common / 10, at most 1.

    Over all episodes, blocks of about ``share`` episodes meet, those of two stripes in
    one task (``_all_word_pairs``).
    """
    from ..functions.text import tokens

    if within is None:
        met = _all_word_pairs(docs.select("id", tokens(F.col(text_col)).alias("w")), least, share)
    else:
        t = docs.select("id", within, F.explode(tokens(F.col(text_col))).alias("w"))
        x, y = t.alias("x"), t.alias("y")
        met = x.join(y, (F.col(f"x.{within}") == F.col(f"y.{within}")) & (F.col("x.w") == F.col("y.w")) & (F.col("x.id") < F.col("y.id")))
        met = met.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count("*").alias("common")).filter(F.col("common") > least)
    return met.withColumn("strength", F.least(F.lit(1.0), F.col("common") / 10))


def strengthen(links: DataFrame, rate: float = 0.2, prune: float = 0.1) -> DataFrame:
    """Hebbian update min(1, w + rate * s) of (a, b, weight, strength); weak links go."""
    return links.withColumn("weight", F.least(F.lit(1.0), F.col("weight") + rate * F.col("strength"))).filter(F.col("weight") >= prune)


def tag_links(docs: DataFrame, each: int = 3) -> DataFrame:
    """(tag, source, target): the first few records of a tag, linked in order."""
    t = docs.select("id", "created_at", F.explode("tags").alias("tag"))
    r = t.withColumn("r", F.row_number().over(W.partitionBy("tag").orderBy("created_at", "id"))).filter(F.col("r") <= each)
    x, y = r.alias("x"), r.alias("y")
    return x.join(y, (F.col("x.tag") == F.col("y.tag")) & (F.col("x.r") < F.col("y.r"))).select(F.col("x.tag").alias("tag"), F.col("x.id").alias("source"), F.col("y.id").alias("target"))
