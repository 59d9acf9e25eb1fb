"""Time: activation, daily accesses, validity intervals, rate limits."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import global_rank
from ..storage import durable

# Tags whose records are never let go.
PROTECTED = ("identity", "safety", "confirmed_preference", "obligation")
DAYS = 30
DAY, INF = 86400, float("inf")
#: Seconds of the finest bins of an interval join; rows of a key beyond which it is cut
#: into bins; notices of a target that are folded in one task, about.
UNIT, HOT, SEGMENT_ROWS = 64.0, 1000, 1 << 16


def daily_accesses(accesses: DataFrame) -> DataFrame:
    """(id, day, observed_at): one meaningful access a UTC day, the last of it."""
    return accesses.groupBy("id", F.floor(F.col("observed_at") / 86400).cast("long").alias("day")).agg(F.max("observed_at").alias("observed_at"))


def activation(docs: DataFrame, accesses: DataFrame, now: float) -> DataFrame:
    """(id, score, base, salience, recency, protected, access_days).

    base is ln of (age + 1)^-1/2 and of (age of a day + 1)^-1/2 over at most the
    last 30 distinct access days since creation; salience is importance within
    [0, 1]; recency is 0.25 / (age + 1).
    """
    own = accesses.join(docs.select("id", "created_at"), "id").filter((F.col("observed_at") >= F.col("created_at")) & (F.col("observed_at") <= now))
    days = own.groupBy("id").agg(F.collect_set(F.floor(F.col("observed_at") / 86400).cast("long")).alias("d"))
    days = days.select("id", F.slice(F.sort_array("d", asc=False), 1, DAYS).alias("d"))
    age = F.greatest(F.lit(0.0), (now - F.col("created_at")) / 86400)
    d = F.coalesce("d", F.array().cast("array<bigint>"))
    strength = F.pow(age + 1, F.lit(-0.5)) + F.aggregate(F.sort_array(d), F.lit(0.0), lambda s, x: s + F.pow(now / 86400 - x + 1, F.lit(-0.5)))
    salience = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("importance")))
    recency = 0.25 / (age + 1)
    out = docs.join(days, "id", "left")
    protected = F.arrays_overlap("tags", F.array(*[F.lit(x) for x in PROTECTED]))
    return out.select("id", (F.ln(strength) + salience + recency).alias("score"), F.ln(strength).alias("base"), salience.alias("salience"), recency.alias("recency"), F.coalesce(protected, F.lit(False)).alias("protected"), F.size(d).cast("long").alias("access_days"))


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], unit: float = UNIT, hot: int = HOT) -> DataFrame:
    """Pairs (x, y: structs of the rows) with equal keys whose closed intervals meet.

    Both sides have ``keys``, f and t (null is unbounded).  Rows of a key that few
    share meet by the key alone.  For others, two intervals meet where the one that
    begins later begins inside the other: an interval is cut into dyadic bins of
    ``unit`` * 2^k seconds, two a level at most, and a beginning is looked up in its
    bin at each level.  So the rows of a hot key are dealt over its bins, and what
    meets in a bin overlaps, but for the ends that share a unit.
    """
    sides = [df.withColumn("f", F.coalesce("f", F.lit(-INF))).withColumn("t", F.coalesce("t", F.lit(INF))).filter("f <= t") for df in (left, right)]
    counts = sides[0].select(*keys).unionByName(sides[1].select(*keys)).groupBy(*keys).count().filter(F.col("count") > hot)
    # at most a key for each ``hot`` rows
    counts = durable(counts.select(*keys), "hot")
    row = lambda df: F.struct(*[F.col(c) for c in df.columns if c not in keys])
    cold = [df.join(counts, keys, "left_anti").select(*keys, row(df).alias(n)) for df, n in zip(sides, "xy")]
    meets = (F.col("x.t") >= F.col("y.f")) & (F.col("y.t") >= F.col("x.f"))
    out = cold[0].join(cold[1], keys).filter(meets).select(*keys, "x", "y")
    if counts.isEmpty():
        return out
    x, y = (df.join(counts, keys, "left_semi").select(*keys, row(df).alias(n)) for df, n in zip(sides, "xy"))
    ends = x.select("x.f", "x.t").unionByName(y.select("y.f", "y.t"))
    finite = lambda c: F.when(F.abs(c) < INF, F.col(c))
    low, high = ends.agg(F.least(F.min(finite("f")), F.min(finite("t"))), F.greatest(F.max(finite("f")), F.max(finite("t")))).first()
    low, high = low if low is not None else 0.0, high if high is not None else 0.0
    levels = max(1, int((high - low) / unit).bit_length() + 1)
    place = lambda c: F.floor((F.least(F.greatest(F.col(c), F.lit(low)), F.lit(high)) - low) / unit).cast("long")
    level = F.sequence(F.lit(0), F.lit(levels - 1))

    def begins(df: DataFrame, name: str) -> DataFrame:
        bins = F.transform(level, lambda k: F.struct(k.alias("level"), F.call_function("shiftright", place(f"{name}.f"), k).alias("bin")))
        return df.select(*keys, name, F.inline(bins))

    def covers(df: DataFrame, name: str) -> DataFrame:
        first, after = place(f"{name}.f"), place(f"{name}.t") + 1

        def at(k: Column) -> Column:
            width = F.call_function("shiftleft", F.lit(1).cast("long"), k)
            lo, hi = F.ceil(first / width), F.call_function("shiftright", after, k)
            own = F.array(F.when((lo < hi) & (lo % 2 == 1), lo), F.when((lo < hi) & (hi % 2 == 1), hi - 1))
            return F.transform(F.filter(F.array_distinct(own), lambda b: b.isNotNull()), lambda b: F.struct(k.alias("level"), b.cast("long").alias("bin")))

        return df.select(*keys, name, F.inline(F.flatten(F.transform(level, at))))

    on = [*keys, "level", "bin"]
    # y begins inside x; or x begins inside y, and later than it
    later = begins(y, "y").join(covers(x, "x"), on).filter((F.col("y.f") >= F.col("x.f")) & meets)
    sooner = begins(x, "x").join(covers(y, "y"), on).filter((F.col("x.f") > F.col("y.f")) & meets)
    return out.unionByName(later.select(*keys, "x", "y")).unionByName(sooner.select(*keys, "x", "y"))


def conflicts(claims: DataFrame, **how: float) -> DataFrame:
    """(a, b): a claim and an accepted one of the same subject and predicate that
    disagrees while both are valid; bounds are closed, null is unbounded."""
    own = claims.select("subject", "predicate", "id", "object", "polarity", F.col("valid_from").alias("f"), F.col("valid_to").alias("t"), "status")
    met = overlapping(own, own.filter("status = 'ACCEPTED'"), ["subject", "predicate"], **how)
    differ = (F.col("x.object") != F.col("y.object")) | (F.col("x.polarity") != F.col("y.polarity"))
    return met.filter(differ & (F.col("x.id") != F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


class _Admission:
    """One target's notices in order of time: what was sent within the windows."""

    def __init__(self, per_hour: int, per_day: int, dedupe: float, state: dict | None = None):
        self.per_hour, self.per_day, self.dedupe = per_hour, per_day, dedupe
        self.sent: list[float] = list(state["sent"]) if state else []
        self.last: dict[str, float] = {k["key"]: k["at"] for k in state["last"]} if state else {}

    def decide(self, at: float | None, key: str | None, silent: bool) -> str:
        if silent:
            return "quiet"
        at = float("nan") if at is None else at
        self.sent = [t for t in self.sent if at - t <= DAY]
        if key in self.last and at - self.last[key] < self.dedupe:
            return "duplicate"
        if sum(at - t <= 3600 for t in self.sent) >= self.per_hour:
            return "hour"
        if len(self.sent) >= self.per_day:
            return "day"
        self.sent.append(at)
        self.last = {k: t for k, t in self.last.items() if at - t < self.dedupe} | {key: at}
        return "sent"

    def state(self, until: float) -> dict:
        """What still bears on notices from ``until`` on, in a fixed order."""
        last = [{"key": k, "at": t} for k, t in self.last.items() if until - t < self.dedupe]
        return {"sent": sorted(t for t in self.sent if until - t <= DAY), "last": sorted(last, key=lambda x: (x["at"], x["key"] is not None, x["key"] or ""))}


_STATE = "struct<sent:array<double>,last:array<struct<key:string,at:double>>>"
_NOBODY = -(1 << 63) + 1


def _decided(limits: tuple):
    """Decisions of one segment whose state at the beginning stands in its rows."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("at", "ascending"), ("id", "ascending")])
        own = _Admission(*limits, table["state"][0].as_py())
        made = [own.decide(*x) for x in zip(*(table[c].to_pylist() for c in ("at", "key", "silent")))]
        return pa.table({"target": table["target"], "id": table["id"], "at": table["at"], "decision": pa.array(made, type=pa.string())})

    return run


def _ends(limits: tuple):
    """State at the end of one segment, from its beginning's."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("at", "ascending"), ("id", "ascending")])
        own = _Admission(*limits, table["state"][0].as_py())
        for x in zip(*(table[c].to_pylist() for c in ("at", "key", "silent"))):
            own.decide(*x)
        kind = pa.struct([("sent", pa.list_(pa.float64())), ("last", pa.list_(pa.struct([("key", pa.string()), ("at", pa.float64())])))])
        return pa.table({"target": pa.array([key[0].as_py()], type=pa.int64()), "seg": pa.array([key[1].as_py()], type=pa.int64()), "end": pa.array([own.state(table["until"][0].as_py())], type=kind)})

    return run


def rate_limited(notices: DataFrame, per_hour: int = 1, per_day: int = 6, dedupe: float = 6 * 3600, quiet: tuple[int, int] = (23, 8), zone: str = "America/Lima", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(target, id, at, decision): admission in order of time for each target.

    Checked in order: quiet hours (unless urgent), the same key within
    ``dedupe`` seconds, the hour's and the day's quota of *admitted* notices.
    ``notices``: target, id, at, key, urgent; a null time comes last.

    Admission depends on what was admitted before, but on the last day only.  A
    target with more than ``segment_rows`` notices is cut into segments of time,
    which are folded at once.  The first fold of a segment assumes that nothing was
    sent before; one whose predecessor ended otherwise than assumed is folded again,
    until all agree.  A quiet day, or quotas that are used up alike, end such a
    change, so the rounds are few; they are never more than the segments of a target.
    """
    limits = (per_hour, per_day, dedupe)
    local = F.hour(F.from_utc_timestamp(F.timestamp_seconds("at"), zone))
    silent = F.coalesce(((local >= quiet[0]) | (local < quiet[1])) & ~F.col("urgent"), F.lit(False))
    # notices of no target are those of one
    rows = notices.select(F.coalesce(F.col("target").cast("long"), F.lit(_NOBODY)).alias("target"), F.col("id").cast("long"), F.col("at").cast("double"), F.col("key").cast("string"), silent.alias("silent"))
    # one segment's length a target: a day and the time of no duplicates at least
    sizes = rows.groupBy("target").agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
    width = F.greatest(F.lit(float(max(DAY, dedupe) + 1)), (F.col("high") - F.col("low")) / F.ceil(F.col("n") / segment_rows) + 1)
    sizes = sizes.select(F.col("target").alias("of"), "low", width.alias("width"))
    cut, last = F.floor((F.col("at") - F.col("low")) / F.col("width")).cast("long"), F.lit(1 << 62).cast("long")
    rows = rows.join(sizes, F.col("target") == F.col("of")).withColumn("seg", F.when(F.col("at").isNull(), last).otherwise(cut))
    rows = durable(rows.withColumn("until", F.when(F.col("at").isNotNull(), F.col("low") + (F.col("seg") + 1) * F.col("width"))).select("target", "seg", "until", "id", "at", "key", "silent"), "notices")
    segments = rows.groupBy("target", "seg").agg(F.count("*").alias("n"))
    before = F.lag("seg").over(W.partitionBy("target").orderBy("seg"))
    # a segment that follows a gap begins with nothing sent
    segments = segments.withColumn("before", before).withColumn("follows", F.coalesce((F.col("seg") == F.col("before") + 1) | (F.col("seg") == last), F.lit(False)) & F.col("before").isNotNull())
    segments = durable(segments.select("target", "seg", "before", "follows"), "segments")
    empty = F.struct(F.array().cast("array<double>").alias("sent"), F.array().cast("array<struct<key:string,at:double>>").alias("last"))
    starts = durable(segments.select("target", "seg", "before", "follows", empty.alias("state")), "starts")
    if not segments.filter("follows").isEmpty():
        # only segments that another one follows need an end
        needed = segments.filter("follows").select("target", F.col("before").alias("seg")).distinct()
        turn, ends = starts, None
        while True:
            fold = rows.join(turn.select("target", "seg", "state"), ["target", "seg"]).join(needed, ["target", "seg"], "left_semi")
            fresh = fold.groupBy("target", "seg").applyInArrow(_ends(limits), f"target long, seg long, end {_STATE}")
            ends = durable(fresh if ends is None else ends.join(turn.select("target", "seg"), ["target", "seg"], "left_anti").unionByName(fresh), "ends")
            came = ends.select("target", F.col("seg").alias("before"), "end")
            now = starts.filter("follows").join(came, ["target", "before"]).withColumn("moved", F.to_json("end") != F.to_json("state"))
            turn = durable(now.filter("moved").select("target", "seg", "before", "follows", F.col("end").alias("state")), "turn")
            if turn.isEmpty():
                break
            starts = durable(starts.join(turn.select("target", "seg"), ["target", "seg"], "left_anti").unionByName(turn), "starts")
    ready = rows.join(starts.select("target", "seg", "state"), ["target", "seg"])
    made = ready.groupBy("target", "seg").applyInArrow(_decided(limits), "target long, id long, at double, decision string")
    return made.withColumn("target", F.nullif("target", F.lit(_NOBODY)))


def pruned(events: DataFrame, now: float, days: int) -> DataFrame:
    """State rows of the last days."""
    return events.filter(F.col("observed_at") >= now - days * 86400)


def novelty_order(docs: DataFrame, support: DataFrame) -> DataFrame:
    """(id, place): by score, records whose names were all seen before going last.

    A record is put off when each of its names occurs in an earlier one; put-off
    records add no names, so a name's first rank decides, in parallel.
    """
    r = global_rank(docs.withColumn("key", -F.col("score")), "key", "id", "r").select("id", "r")
    named = support.select(F.col("episode").alias("id"), "name").join(r, "id")
    # the first rank of a name comes from an aggregate: a common name is one row a task
    first = named.groupBy("name").agg(F.min("r").alias("first"))
    new = named.join(first, "name").groupBy("id").agg(F.max((F.col("r") == F.col("first")).cast("int")).alias("new"))
    late = F.coalesce(F.col("new") == 0, F.lit(False))
    placed = r.join(new, "id", "left").withColumn("key", F.col("r") + F.when(late, F.lit(2.0**52)).otherwise(0.0))
    step = max(1, docs.count() // 16)
    cuts = [float(base + k * step) for base in (0, 2**52) for k in range(1 if not base else 0, 17)]
    return global_rank(placed, "key", "id", "place", cuts=cuts).select("id", "place")
