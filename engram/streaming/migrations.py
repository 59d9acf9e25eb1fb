"""Numbered migrations of a store's tables.

Each folder of a table carries the number of the layout it was written in.  A reader
gets rows of the newest layout: folders of older ones go through the migrations that
they lack, one after the other, as they are read.  ``apply`` rewrites such folders
once and commits; what is at the newest number is left alone, so it may run again at
any time, also after it was stopped half way.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame

from .commits import Snapshot, Store

Step = Callable[[DataFrame], DataFrame]


class Migrations:
    """The steps of one table: step k (from 1 on) makes layout k from layout k - 1."""

    def __init__(self, table: str, *steps: Step):
        self.table, self.steps = table, steps

    @property
    def newest(self) -> int:
        return len(self.steps)

    def _folders(self, now: Snapshot) -> dict[int, list[str]]:
        out: dict[int, list[str]] = {}
        for folder in now.manifest["tables"].get(self.table, []):
            number = int(folder.rsplit("/v", 1)[1].split("-")[0])
            if number > self.newest:
                raise ValueError(f"{self.table} has layout {number}; this reader knows {self.newest}")
            out.setdefault(number, []).append(folder)
        return out

    def _raised(self, store: Store, number: int, folders: list[str]) -> DataFrame:
        rows = store.spark.read.option("mergeSchema", "true").parquet(*[f"{store.root}/{f}" for f in folders])
        return reduce(lambda df, step: step(df), self.steps[number:], rows)

    def read(self, now: Snapshot) -> DataFrame:
        """All rows of the table in the newest layout."""
        parts = [self._raised(now.store, k, f) for k, f in sorted(self._folders(now).items())]
        if not parts:
            raise KeyError(self.table)
        return reduce(lambda a, b: a.unionByName(b), parts)

    def write(self, store: Store, rows: DataFrame, **commit) -> int:
        return store.commit({self.table: rows}, schema=self.newest, **commit)

    def apply(self, store: Store) -> list[int]:
        """Rewrite folders of older layouts, a commit for each layout; the layouts."""
        done = []
        for number, folders in sorted(self._folders(store.snapshot()).items()):
            if number < self.newest:
                store.compact(self.table, None, self._raised(store, number, folders), folders, self.newest)
                done.append(number)
        return done
