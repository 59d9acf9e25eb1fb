"""Mixing sources to target weights by entropy balancing.

Each document gets a rate (its expected number of copies) that is closest in
entropy to one copy each, under the constraint that its source's expected
tokens equal a target.  The solution tilts the rate exponentially in document
size: rate = 3 / (1 + 2 exp(-lambda * size / mean)), one lambda a source, which
is 1 at lambda = 0 and never above 3.  The convex dual is solved by safeguarded
Newton steps, first over bins of sizes, then over all (source, size) cells, each
step one aggregation.  Rates are rounded to whole copies by systematic rounding
along the sizes, so the sum of a source stays within about one document of its
target, and a few copies of one size close the rest.

Everything is a DataFrame expression.  Documents are pre-aggregated to cells
before any step, so a source with a third of all rows is a few thousand cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rows import bounded
from .storage import durable, release, tables

WEIGHTS = (1, 2, 3)
MOST = 3
#: Newton rounds over all cells, each one job, and steps of the start over bins.
ROUNDS, STEPS = 12, 24
#: Sizes up to this one are bins of their own; beyond it there are 64 in each octave.
EXACT_SIZES = 1024
#: Documents of one cell that are ranked together, about, and the least number of parts.
PART_ROWS, LEAST_PARTS = 1 << 18, 64


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: sid, source, source_size, target.

    Sources in code-point order (null last) share all tokens by the weights,
    repeating.  A target stops at ``most`` times its source's size; the excess
    is shared again by weight until none is above: the water level is the
    remaining tokens over the remaining weight once the sources that stop
    first, in order of most * size / weight, are taken out.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    k = F.row_number().over(order)
    table = F.array(*[F.lit(float(x)) for x in weights])
    s = sums.withColumn("sid", k.cast("int")).withColumn("w", F.element_at(table, ((k - 1) % len(weights) + 1).cast("int")))
    s = s.withColumns({"top": most * F.col("source_size").cast("double"), "all": F.sum("source_size").over(W.partitionBy()).cast("double"), "all_w": F.sum("w").over(W.partitionBy())})
    before = W.orderBy(F.col("top") / F.col("w"), "sid").rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("level", (F.col("all") - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("stops", F.col("top") <= F.col("level") * F.col("w"))
    # the level of the first source that doesn't stop holds for all that don't
    free = F.min(F.when(~F.col("stops"), F.struct((F.col("top") / F.col("w")).alias("r"), "sid", "level"))).over(W.partitionBy())
    target = F.when(F.col("stops"), F.col("top")).otherwise(free["level"] * F.col("w"))
    return s.select("sid", "source", "source_size", target.alias("target"))


def _rate(lam: Column, x: Column, most: int) -> Column:
    z = F.greatest(F.least(-lam * x, F.lit(500.0)), F.lit(-500.0))
    return most / (1 + (most - 1) * F.exp(z))


def _moved(got: Column, slope: Column) -> tuple[Column, Column, Column]:
    """lam, lo and hi after a safeguarded Newton step from columns of these names."""
    lam, lo, hi, target = (F.col(c) for c in ("lam", "lo", "hi", "target"))
    low = got < target
    lo2, hi2 = F.when(low, lam).otherwise(lo), F.when(low, hi).otherwise(lam)
    newton = F.when(slope > 0, lam + (target - got) / slope)
    # while one side is open, bisection would be far off: double instead
    wide = F.when(low, F.greatest(lo2 * 2, F.lit(1.0))).otherwise(F.least(hi2 * 2, F.lit(-1.0)))
    safe = F.when((hi2 - lo2) > 5e3, wide).otherwise((lo2 + hi2) / 2)
    inside = (newton > lo2) & (newton < hi2) & (F.abs(newton - lam) < 8)
    return F.coalesce(F.when(inside, newton), safe), lo2, hi2


def _start(cells: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """The dual solved over bins of sizes, a few thousand a source at most."""
    octave = F.floor(F.log2(F.col("size").cast("double")) * 64) + EXACT_SIZES
    bins = cells.groupBy("sid", F.when(F.col("size") <= EXACT_SIZES, F.col("size")).otherwise(octave).alias("bin")).agg(F.sum(F.col("n") * F.col("size")).cast("double").alias("w"), F.sum("n").alias("k"))
    held = bins.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("bin", "w", "k"))).alias("bins"), F.sum("w").alias("all_w"), F.sum("k").alias("all_k"))
    held = held.join(sources.filter("source_size > 0").select("sid", "target", "source_size"), "sid").withColumn("bins", F.expr("transform(bins, b -> named_struct('w', b.w, 'x', b.w / b.k / (all_w / all_k)))"))
    full = F.col("target") >= F.col("source_size") * most * (1 - 1e-12)
    rated = f"transform(bins, b -> named_struct('w', b.w, 'x', b.x, 'r', {most} / (1 + {most - 1} * exp(greatest(least(-s.lam * b.x, 500D), -500D)))))"
    sums = f"aggregate({rated}, named_struct('got', 0D, 'slope', 0D), (a, b) -> named_struct('got', a.got + b.w * b.r, 'slope', a.slope + b.w * b.x * b.r * (1 - b.r / {most})))"
    low, state = "g.got < target", "named_struct('lam', {}, 'lo', {}, 'hi', {})"
    lo, hi = f"IF({low}, s.lam, s.lo)", f"IF({low}, s.hi, s.lam)"
    newton = "s.lam + (target - g.got) / g.slope"
    safe = f"IF({hi} - ({lo}) > 5e3, IF({low}, greatest(({lo}) * 2, 1D), least(({hi}) * 2, -1D)), (({lo}) + ({hi})) / 2)"
    fits = f"g.slope > 0 AND {newton} > {lo} AND {newton} < {hi} AND abs({newton} - s.lam) < 8"
    # a step sees the sums of its own state: they are made as the one element of an array
    step = f"transform(array({sums}), g -> {state.format(f'IF({fits}, {newton}, {safe})', lo, hi)})[0]"
    solved = F.expr(f"aggregate(sequence(1, {STEPS}), {state.format('0D', '-1e4', '1e4')}, (s, k) -> {step}, s -> s.lam)")
    return held.select("sid", "target", full.alias("full"), F.when(full, 0.0).otherwise(solved).alias("lam"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"))


def _solve(cells: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """lambda of each source: safeguarded Newton on the dual's gradient.

    The start is close, so one or two rounds over all cells are the rule.  Sums
    are of decimals, so that they don't depend on the order of a shuffle.
    """
    state = durable(_start(cells, sources, most), "dual")
    for _ in range(ROUNDS):
        r = _rate(F.col("lam"), F.col("x"), most)
        size = F.col("n") * F.col("size")
        exact = lambda c: F.sum(c.cast("decimal(28,6)")).cast("double")
        sums = cells.join(state.filter("NOT full"), "sid").groupBy("sid").agg(exact(size * r).alias("got"), exact(size * F.col("x") * r * (1 - r / most)).alias("slope"))
        step = state.join(sums, "sid", "left").withColumn("miss", F.abs(F.col("got") / F.col("target") - 1))
        lam, lo, hi = _moved(F.col("got"), F.col("slope"))
        done = F.col("full") | (F.col("miss") < 1e-9)
        fresh = step.select("sid", "target", "full", *[F.when(done, F.col(c)).otherwise(new).alias(c) for c, new in (("lam", lam), ("lo", lo), ("hi", hi))], "miss")
        before, state = state, durable(fresh, "dual")
        release(before)
        worst = state.filter("NOT full").agg(F.max("miss")).first()[0]
        if worst is None or worst < 1e-9:
            break
    return state.select("sid", "full", "lam")


def copies(sized: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """(sid, size, n, c): the whole copies that the n documents of a cell share."""
    cells = sized.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    mean = W.partitionBy("sid")
    cells = cells.join(sources.select("sid", "source"), cells["source"].eqNullSafe(sources["source"])).select("sid", "size", "n")
    cells = durable(cells.withColumn("x", F.col("size") / (F.sum(F.col("n") * F.col("size")).over(mean) / F.sum("n").over(mean))), "cells")
    lam = _solve(cells, sources, most)
    rated = cells.join(lam, "sid").withColumn("e", F.col("n") * F.when(F.col("full"), F.lit(float(most))).otherwise(_rate(F.col("lam"), F.col("x"), most)))
    upto = W.partitionBy("sid").orderBy("size").rowsBetween(W.unboundedPreceding, W.currentRow)
    total = F.floor(F.sum("e").over(upto) + 0.5)
    dealt = rated.withColumn("upto", total).withColumn("c", F.col("upto") - F.coalesce(F.lag("upto").over(W.partitionBy("sid").orderBy("size")), F.lit(0)))
    dealt = dealt.select("sid", "size", "n", F.greatest(F.least("c", F.col("n") * most), F.lit(0)).cast("long").alias("c"))
    dealt = durable(dealt, "dealt")
    for _ in range(3):  # a few copies more or less of the size that brings the source nearest
        got = dealt.groupBy("sid").agg(F.sum(F.col("c") * F.col("size")).alias("got"))
        gap = got.join(sources.select("sid", "target"), "sid").select("sid", (F.col("target") - F.col("got")).alias("gap"))
        room = F.when(F.col("gap") > 0, F.col("n") * most - F.col("c")).otherwise(F.col("c"))
        k = F.least(room, F.greatest(F.lit(1), F.round(F.abs("gap") / F.col("size")))).cast("long")
        after = F.abs(F.abs(F.col("gap")) - k * F.col("size"))
        fits = (k > 0) & (after < F.abs(F.col("gap")))
        best = dealt.join(gap, "sid").filter(fits).groupBy("sid").agg(F.min(F.struct(F.round(after, 6).alias("after"), k.alias("k"), "size", F.signum("gap").cast("long").alias("d"))).alias("b"))
        best = best.select("sid", F.col("b.size").alias("size"), (F.col("b.d") * F.col("b.k")).alias("d"))
        before, dealt = dealt, durable(dealt.join(best, ["sid", "size"], "left").select("sid", "size", "n", (F.col("c") + F.coalesce("d", F.lit(0))).alias("c")), "dealt")
        release(before)
    release(cells)
    return dealt


def _order(parts: int, id_col: str, source_col: str, text_col: str) -> Column:
    """Where a row stands in its cell: by a hash of the id (dealt to parts), then by the
    id, then by a hash of the row."""
    h = F.xxhash64(F.col(id_col))
    row = F.xxhash64(F.col(id_col), F.col(source_col), F.col(text_col))
    return F.struct(F.pmod(h, F.lit(parts)).cast("int").alias("b"), h.alias("h"), F.col(id_col).alias("doc_id"), row.alias("row"))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows (size, sid, source_size, target, place, whole, extra), one for each row of
    ``docs``; sources; parts of a cell.  A row gets ``whole`` copies, and one more
    where ``extra`` is set: to the first of its cell by ``place``."""
    parts = max(LEAST_PARTS, docs.count() // PART_ROWS)
    sized = durable(docs.select(F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), _order(parts, id_col, source_col, text_col).alias("place")), "sized")
    sources = durable(source_targets(sized, weights, most), "sources")
    cells = copies(sized, sources, most)
    rows = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select("size", "sid", "source_size", "target", "place", "place.b")
    # the rank inside a cell: rows in earlier parts, and the place in the own part
    before = W.partitionBy("sid", "size").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    ahead = rows.groupBy("sid", "size", "b").agg(F.count("*").alias("k")).withColumn("ahead", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    deal = ahead.join(cells.select("sid", "size", "n", "c"), ["sid", "size"])
    own = F.row_number().over(W.partitionBy("sid", "size", "b").orderBy("place"))
    out = rows.withColumn("r", own).join(deal, ["sid", "size", "b"], "left")
    extra = F.coalesce(F.col("ahead") + F.col("r") <= F.col("c") % F.col("n"), F.lit(False))
    return out.select("size", "sid", "source_size", "target", "place", F.coalesce(F.floor(F.col("c") / F.col("n")), F.lit(0)).cast("long").alias("whole"), extra.alias("extra")), sources, parts


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken.

    A null text has size 0 and takes nothing; a null source is a source of its
    own, the last.  Documents of one cell (source and size) that get a copy
    more are those first by a hash of the id, so reruns agree; rows that repeat
    an id count one by one.  An empty table gives an empty result; further
    columns are ignored, whatever their names.  What is in one task grows with
    the number of sources, or of different sizes in one source, only.
    """
    rows, _, _ = _mixed(docs, id_col, text_col, source_col, weights, most)
    n = F.col("whole") + F.col("extra").cast("long")
    return rows.select("place.doc_id", "size", "source_size", "target", n.alias("copies"), (n * F.col("size")).alias("taken"))


def repeat_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row as often as the mix takes it, columns unchanged.

    Rows with the same id, source and text share what was dealt to them, one
    by one where that leaves a rest.  Null texts and texts without words go.
    """
    names = docs.columns
    with tables() as keep:
        rows, sources, parts = _mixed(docs, id_col, text_col, source_col, WEIGHTS, MOST)
        rows = durable(rows.select("size", "sid", "place", "whole", "extra"), "rows")
        last = F.max(F.when(F.col("extra"), F.col("place")))
        cells = rows.groupBy("sid", "size").agg(F.max("whole").alias("whole"), last.alias("last")).filter("whole > 0 OR last IS NOT NULL")
        # rows that are the same in all share a place: how many of the last get a copy more
        same = rows.join(cells.select("sid", "size", "last"), ["sid", "size"]).filter("place = last").groupBy("sid", "size").agg(F.count("*").alias("rows"), F.count_if("extra").alias("more"))
        torn = same.filter("more < rows").select("sid", "size", "more")
        cells = cells.join(torn, ["sid", "size"], "left").join(sources.select("sid", "source"), "sid")
        cells = keep(durable(cells.select(F.col("source").alias("__source"), F.col("size").alias("__size"), "whole", "last", "more"), "cells"))
    # what is dealt is a row a cell: documents meet it by their own source and size
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__doc"), F.col(source_col).alias("__own"), size_of(F.col(text_col)).alias("__size"), _order(parts, id_col, source_col, text_col).alias("__place"))
    met = held.join(bounded(cells), F.col("__own").eqNullSafe(F.col("__source")) & (held["__size"] == cells["__size"]))
    met = met.withColumn("__torn", F.coalesce(F.col("more").isNotNull() & (F.col("__place") == F.col("last")), F.lit(False)))
    first = F.coalesce(F.col("__place") <= F.col("last"), F.lit(False))
    each = met.filter("NOT __torn").select("__doc", (F.col("whole") + first.cast("long")).alias("__n"))
    if not cells.filter("more IS NOT NULL").isEmpty():
        nth = F.row_number().over(W.partitionBy("__place").orderBy(F.xxhash64("__doc")))
        each = each.unionByName(met.filter("__torn").select("__doc", (F.col("whole") + (nth <= F.col("more")).cast("long")).alias("__n")))
    each = each.filter("__n > 0")
    return each.select("__doc", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))).alias("__k")).select("__doc.*")
