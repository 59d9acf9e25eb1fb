"""Source divergence audit: how far the sources of a language are from each other.

Every (language, source) group has a smoothed share of each kept term; two groups
are as far apart as the sum over terms of the absolute difference of their shares.
All shares and sums are whole numbers, so the result doesn't depend on any order.

The sum over terms is split (heavy-light).  Terms that many groups hold are laid
out as dense numpy tiles, a block of groups by a block of terms, and each pair of
tiles gives a partial sum.  A rare term is a posting list: a group without it has
the base share, so its pairs are the base difference of all rare terms, corrected
for each posting on its own (from counts of equal shares, with prefix sums) and
for each pair of postings that meet.  The partial sums are added by pair.

Texts are counted where the partitions are, so a source with a third of all rows
sends one row a partition and term; a task holds tiles and lists of bounded size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import durable, release

#: A term is kept by a language if so many of its documents hold it.
LEAST_DOCS = 30
#: Whole shares are of this total; what is added to each count.
SCALE, SMOOTH = 1_000_000_000, 5
#: Terms that at least this share of a language's groups hold (two at least) are heavy.
HEAVY_SHARE = 0.5
#: Groups and, about, terms of a dense tile; meetings of postings that one task takes, about.
TILE_GROUPS, TILE_TERMS, MEETINGS = 128, 2048, 1 << 20
#: Terms that a partition holds before it sends them on; bytes of a text counted at a time.
HELD, SLICE = 1 << 18, 1 << 22

_LETTERS = re.compile(rb"[a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^a-z\x80-\xff]")
_COUNTS = "lang string, source string, term string, n long, df long"
_PARTIAL = pa.schema([("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("v", pa.int64())])
_PARTIAL_DDL = "lang string, a int, b int, v long"


def _words(text: bytes) -> Iterator[list[bytes]]:
    """All terms of a whole text, in slices that end between terms."""
    low, at = text.lower(), 0
    while at < len(low):
        end = at + SLICE
        cut = _BREAK.search(low, end)
        end = cut.start() if cut else len(low)
        yield _LETTERS.findall(low, at, end)
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, df) of a partition: occurrences and documents."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            if n:
                terms = pa.array(list(n), type=pa.binary()).view(pa.string())
                name = lambda x: pa.array([x] * len(n), type=pa.string())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([name(lang), name(source), terms, pa.array(n.values(), type=pa.int64()), pa.array([df[t] for t in n], type=pa.int64())], names=["lang", "source", "term", "n", "df"])
        held.clear()

    for batch in batches:
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
            n, df = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for words in _words(text):
                n.update(words)
                seen.update(words)
            df.update(seen)
        if sum(len(n) for n, _ in held.values()) >= HELD:
            yield from flush()
    yield from flush()


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (total + SMOOTH * terms)), without overflow."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.expr("1L") + F.call_function("div", whole(F.lit(SCALE)) * whole(n + SMOOTH), whole(total + SMOOTH * terms))


def _pair_rows(lang: str, a: np.ndarray, b: np.ndarray, v: np.ndarray) -> pa.Table:
    """Partial sums, each pair once with the smaller number first."""
    key = (np.minimum(a, b).astype(np.int64) << 32) | np.maximum(a, b)
    order = np.argsort(key, kind="stable")
    key, v = key[order], v[order].astype(np.int64)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    sums = np.add.reduceat(v, first) if len(first) else v
    key = key[first]
    return pa.Table.from_arrays([pa.array([lang] * len(key), type=pa.string()), pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(sums)], schema=_PARTIAL)


def _tiles(key: tuple, table: pa.Table) -> pa.Table:
    """Sums over a block of heavy terms for all pairs of two blocks of groups.

    A row without a term is a group's base share, which fills its line.
    """
    lang, gi, gj = key[0].as_py(), key[2].as_py(), key[3].as_py()
    gid, p = table["gid"].to_numpy(), table["p"].to_numpy()
    base = table["term"].is_null().to_numpy()
    terms = table["term"].combine_chunks()
    terms = (terms if isinstance(terms, pa.Array) else terms.chunk(0)).dictionary_encode()
    at, width = terms.indices.fill_null(0).to_numpy(), len(terms.dictionary)

    def tile(block: int) -> tuple[np.ndarray, np.ndarray]:
        own = gid // TILE_GROUPS == block
        ids, first = np.unique(gid[own & base], return_index=True)
        dense = np.repeat(p[own & base][first][:, None], width, axis=1)
        put = own & ~base
        dense[np.searchsorted(ids, gid[put]), at[put]] = p[put]
        return ids, dense

    ids_a, a = tile(gi)
    ids_b, b = (ids_a, a) if gi == gj else tile(gj)
    left, right, sums = [], [], []
    for k, line in enumerate(a):
        rest = slice(k + 1, None) if gi == gj else slice(None)
        sums.append(np.abs(b[rest] - line).sum(axis=1, dtype=np.int64))
        right.append(ids_b[rest])
        left.append(np.full(len(sums[-1]), ids_a[k]))
    if not left:
        return _PARTIAL.empty_table()
    return _pair_rows(lang, np.concatenate(left), np.concatenate(right), np.concatenate(sums))


def _alone(key: tuple, table: pa.Table) -> pa.Table:
    """The base difference of all rare terms, and what each posting changes by itself.

    Rows with ``n`` 0 are the base shares of all groups of the language; the
    others count the postings of one share in the groups of one block.
    """
    lang, block = key[0].as_py(), key[1].as_py()
    gid, p, n = (table[c].to_numpy() for c in ("gid", "p", "n"))
    light = table["light"][0].as_py()
    ids, first = np.unique(gid[n == 0], return_index=True)
    x = p[n == 0][first].astype(np.int64)
    left, right, sums = [], [], []
    for a in ids[ids // TILE_GROUPS == block]:
        own = (gid == a) & (n > 0)
        order = np.argsort(p[own])
        q, c = p[own][order].astype(np.int64), n[own][order].astype(np.int64)
        count, total = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * q)])
        k = np.searchsorted(q, x)
        apart = np.abs(x[np.searchsorted(ids, a)] - x)
        moved = x * count[k] - total[k] + (total[-1] - total[k]) - x * (count[-1] - count[k]) - count[-1] * apart
        other = ids != a
        sums.append((moved + np.where(ids > a, light * apart, 0))[other])
        right.append(ids[other])
        left.append(np.full(len(right[-1]), a))
    if not left:
        return _PARTIAL.empty_table()
    return _pair_rows(lang, np.concatenate(left), np.concatenate(right), np.concatenate(sums))


def _meetings(key: tuple, table: pa.Table) -> pa.Table:
    """What pairs of postings of one rare term change beside each posting's own part."""
    terms = table["term"].combine_chunks()
    at = (terms if isinstance(terms, pa.Array) else terms.chunk(0)).dictionary_encode().indices.to_numpy()
    order = np.lexsort((table["gid"].to_numpy(), at))
    gid, p, base = (table[c].to_numpy()[order] for c in ("gid", "p", "p0"))
    begin = np.flatnonzero(np.diff(at[order], prepend=-1))
    size = np.diff(np.append(begin, len(gid)))
    done, held, waiting = [_PARTIAL.empty_table()], [], 0

    def summed() -> None:
        if held:
            done.append(_pair_rows(key[0].as_py(), *map(np.concatenate, zip(*held))))
            held.clear()

    for k in np.unique(size[size > 1]):
        starts = begin[size == k]
        for m in range(k - 1):  # posting m of all lists of this length, with those after it
            after = np.arange(m + 1, k)
            i, j = np.repeat(starts + m, len(after)), (starts[:, None] + after).ravel()
            held.append((gid[i], gid[j], np.abs(p[i] - p[j]) - np.abs(p[i] - base[j]) - np.abs(base[i] - p[j]) + np.abs(base[i] - base[j])))
            waiting += len(i)
            if waiting >= MEETINGS:
                summed()
                waiting = 0
    summed()
    return pa.concat_tables(done)


def _postings(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, k, ln, lead) of kept terms: k groups hold the term, ln
    times in the language; ``lead`` is set in one of its rows."""
    counts = docs.mapInArrow(_counted, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    # at most a row a source in a window
    term = W.partitionBy("lang", "term")
    kept = counts.withColumns({"all": F.sum("df").over(term), "k": F.count("*").over(term), "ln": F.sum("n").over(term), "lead": F.col("source") == F.min("source").over(term)})
    return kept.filter(F.col("all") >= least_docs).select("lang", "source", "term", "n", "k", "ln", "lead")


def _groups(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, gid, groups, terms, total, lang_total, p0) of every group."""
    langs = postings.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.when(F.col("lead"), 1)).alias("terms"))
    own = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    every = every.fillna(0, ["total", "terms", "lang_total"])
    every = every.withColumns({"gid": (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("int"), "groups": F.count("*").over(W.partitionBy("lang"))})
    return every.withColumn("p0", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0))


def _distances(groups: DataFrame, rows: DataFrame, share: float) -> DataFrame:
    """(lang, a, b, value) for every two groups of a language, a < b."""
    heavy, lead = F.col("heavy"), F.col("lead")
    meetings = F.col("k") * (F.col("k") - 1) / 2
    sizes = rows.groupBy("lang").agg(F.count(F.when(heavy & lead, 1)).alias("dense"), F.sum(F.when(~heavy & lead, meetings).otherwise(0)).alias("met"))
    langs = groups.groupBy("lang").agg(F.max("terms").alias("terms"), F.max("groups").alias("groups")).join(sizes, "lang", "left").fillna(0, ["dense", "met"])
    langs = durable(langs.select(
        "lang", F.ceil(F.col("groups") / TILE_GROUPS).cast("int").alias("gblocks"), (F.col("terms") - F.col("dense")).alias("light"),
        F.ceil(F.col("dense") / TILE_TERMS).cast("int").alias("tblocks"), F.greatest(F.lit(1), F.ceil(F.col("met") / MEETINGS)).cast("int").alias("lblocks"),
    ), "langs")
    block = lambda blocks: F.pmod(F.xxhash64("term"), F.col(blocks)).cast("int")
    held = rows.join(langs, "lang")
    bases = groups.select("lang", "gid", F.col("p0").alias("p")).join(langs, "lang")
    upto = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    marks = bases.filter("tblocks > 0").select("lang", "gblocks", "gid", F.lit(None).cast("string").alias("term"), "p", upto("tblocks").alias("tb"))
    dense = held.filter(heavy).select("lang", "gblocks", "gid", "term", "p", block("tblocks").alias("tb")).unionByName(marks)
    own, other = F.floor(F.col("gid") / TILE_GROUPS).cast("int"), F.col("other")
    dense = dense.select("lang", "tb", "gid", "term", "p", own.alias("own"), upto("gblocks").alias("other"))
    dense = dense.select("lang", "tb", F.least("own", other).alias("gi"), F.greatest("own", other).alias("gj"), "gid", "term", "p")
    tiles = dense.groupBy("lang", "tb", "gi", "gj").applyInArrow(_tiles, _PARTIAL_DDL)

    counts = held.filter(~heavy).groupBy("lang", "light", "gid", "p").agg(F.count("*").alias("n")).select("lang", own.alias("block"), "gid", "p", "n", "light")
    marks = bases.select("lang", upto("gblocks").alias("block"), "gid", "p", F.lit(0).cast("long").alias("n"), "light")
    alone = counts.unionByName(marks).groupBy("lang", "block").applyInArrow(_alone, _PARTIAL_DDL)

    lists = held.filter(~heavy & (F.col("k") > 1)).select("lang", block("lblocks").alias("lb"), "gid", "term", "p", "p0")
    met = lists.groupBy("lang", "lb").applyInArrow(_meetings, _PARTIAL_DDL)
    return tiles.unionByName(alone).unionByName(met).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = 50, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (language, source) group.

    Part ``pair`` ranks all other sources of the language by distance, part
    ``term`` the first ``top`` kept terms by how far the group's share lies above
    the language's.  Null texts, languages and sources count as empty; rows count
    one by one, whatever their ids.  A group without terms has base shares; a
    language without kept terms has distances of 0 and no terms.  An empty table
    gives an empty result; further columns are ignored, whatever their names.
    """
    named = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    postings = durable(_postings(named, least_docs), "postings")
    groups = durable(_groups(named, postings), "groups")
    least = F.greatest(F.lit(2), F.ceil(F.col("groups") * heavy_share))
    rows = postings.join(groups, ["lang", "source"]).select(
        "lang", "source", "gid", "term", "k", "lead", "p0", (F.col("k") >= least).alias("heavy"),
        _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), _share(F.col("ln"), F.col("lang_total"), F.col("terms")).alias("q"),
    )
    rows = durable(rows, "shares")
    release(postings)
    pairs = _distances(groups, rows, heavy_share)
    both = pairs.select("lang", "a", "b", "value").unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    name = lambda gid, as_: groups.select("lang", F.col("gid").alias(gid), F.col("source").alias(as_))
    both = both.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    above = rows.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
