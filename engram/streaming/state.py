"""Stateful streams: a working memory with expiry and a capacity for each owner."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What each change of an owner's memory gives.
SCHEMA = "owner string, version long, ids array<string>, gone array<string>, why string"


class WorkingMemory(StatefulProcessor):
    """The last ``capacity`` ids put by an owner, each for ``ttl`` seconds of event time.

    State is a map from id to the time of its last put, so a put touches its own
    entry only.  The one put longest ago goes first (of one time, by id).  An entry
    goes when the watermark passes its time plus ``ttl``, by a timer; an owner that
    says nothing more keeps nothing.
    """

    def __init__(self, ttl: float, capacity: int):
        self.ttl, self.capacity = ttl, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "id string", "at double")
        self.version = handle.getValueState("version", "n long")

    def _held(self) -> dict[str, float]:
        return {k[0]: v[0] for k, v in self.items.iterator()}

    def _told(self, key: tuple, held: dict[str, float], gone: list[str], why: str) -> pd.DataFrame:
        n = self.version.get()[0] + 1 if self.version.exists() else 1
        self.version.update((n,))
        ids = sorted(held, key=lambda k: (-held[k], k))
        return pd.DataFrame({"owner": [key[0]], "version": [n], "ids": [ids], "gone": [sorted(gone)], "why": [why]})

    def _due(self, at: float) -> int:
        return int(at * 1000 + self.ttl * 1000) + 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the last put of each id counts, whatever the order of the rows
        puts: dict[str, float] = {}
        for pdf in rows:
            for id_, at in pdf.groupby("id")["at"].max().items():
                puts[id_] = max(at, puts.get(id_, at))
            if len(puts) > 4 * self.capacity:
                puts = dict(sorted(puts.items(), key=lambda x: (-x[1], x[0]))[: self.capacity])
        before = self._held()
        held = {k: max(puts.get(k, at), at) for k, at in before.items()} | {k: at for k, at in puts.items() if k not in before}
        past = timerValues.getCurrentWatermarkInMs()
        order = sorted(held, key=lambda k: (-held[k], k))
        stay = {k: held[k] for k in order[: self.capacity] if self._due(held[k]) > past}
        for k in before:
            if k not in stay:
                self.items.removeKey((k,))
        for k, at in stay.items():
            if before.get(k) != at:
                self.items.updateValue((k,), (at,))
                self.handle.registerTimer(self._due(at))
        yield self._told(key, stay, [k for k in before if k not in stay], "put")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # an id that was put again later has a timer of its own
        due = expiredTimerInfo.getExpiryTimeInMs()
        held = self._held()
        gone = [k for k, at in held.items() if self._due(at) <= due]
        for k in gone:
            self.items.removeKey((k,))
        if gone:
            yield self._told(key, {k: at for k, at in held.items() if k not in gone}, gone, "expired")

    def close(self) -> None:
        pass


def working_memory(puts: DataFrame, ttl: float, capacity: int, late: str = "0 seconds") -> DataFrame:
    """(owner, version, ids, gone, why): an owner's memory after each batch of puts and
    after each expiry, newest id first; the last version is what it holds.

    ``puts`` is a stream of owner, id and ts (timestamp).  The state store must be
    RocksDB (spark.sql.streaming.stateStore.providerClass), as for all timers.
    """
    rows = puts.withWatermark("ts", late).select(F.col("owner").cast("string").alias("owner"), F.col("id").cast("string").alias("id"), (F.unix_micros("ts") / 1e6).alias("at"), "ts")
    return rows.groupBy("owner").transformWithStateInPandas(WorkingMemory(ttl, capacity), SCHEMA, "Update", "EventTime")
