"""New lines of growing files, as a stream.

    spark.dataSource.register(LogTail)
    spark.readStream.format("log_tail").option("path", "/logs/*/sessions/*.jsonl")
        .option("cursor", "/state/tail.json").load()

A file is known by its path and inode.  An offset is the byte after the last whole
line that was taken; only the bytes between two offsets are read, by the tasks, in
ranges of bounded size.  A file whose inode changed, or that is shorter than its
offset, is read anew from its beginning.  Files are those of a folder that the
driver and all executors mount.
"""

from __future__ import annotations

import glob
import json
import os
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that one task reads, about; bytes read at a time when lines are looked for.
RANGE, STEP = 32 << 20, 1 << 16

SCHEMA = "path string, inode long, start long, stop long, line string"


@dataclass
class Span(InputPartition):
    """Lines of a file that begin from ``begin`` on and before ``end``; none goes on
    beyond ``stop``."""

    path: str
    inode: int
    first: int
    begin: int
    end: int
    stop: int


def _last_line_end(path: str, start: int, size: int) -> int:
    """The byte after the last line end between two bytes, or ``start``."""
    with open(path, "rb") as f:
        at = size
        while at > start:
            low = max(start, at - STEP)
            f.seek(low)
            found = f.read(at - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return start


def _after_lines(path: str, start: int, size: int, lines: int, until: float) -> tuple[int, int]:
    """The byte after so many whole lines at most, and how many these are; stops early
    once the clock is past ``until``."""
    at, taken = start, 0
    with open(path, "rb") as f:
        f.seek(start)
        while taken < lines and f.tell() < size and time.monotonic() < until:
            line = f.readline()
            if not line.endswith(b"\n") or at + len(line) > size:
                break
            at, taken = at + len(line), taken + 1
    return at, taken


class TailReader(DataSourceStreamReader):
    """Options: path (a glob), cursor (a file for the last offset that was promised),
    bootstrap (full: a file that is seen for the first time is read from its beginning;
    tail: from where it ends then), lines and lines_each (most lines of a batch, of a
    file in it), seconds (time to plan a batch, which then ends between two files)."""

    def __init__(self, options: dict):
        self.glob = options["path"]
        self.cursor = options.get("cursor")
        self.tail = options.get("bootstrap", "full") == "tail"
        self.lines, self.lines_each = (int(options[k]) if k in options else None for k in ("lines", "lines_each"))
        self.seconds = float(options.get("seconds", "inf"))
        self.known: dict[str, dict] = {}
        # what was promised before is the least that may be promised next, whether Spark
        # had noted it or not: nothing is skipped, nothing is read twice
        if self.cursor and os.path.exists(self.cursor):
            with open(self.cursor, encoding="utf-8") as f:
                self.known = json.load(f)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        until = time.monotonic() + self.seconds
        left = self.lines if self.lines is not None else float("inf")
        files = []
        for path in glob.glob(self.glob, recursive=True):
            try:
                s = os.stat(path)
            except FileNotFoundError:
                continue
            files.append((s.st_mtime, path, s.st_ino, s.st_size))
        out = dict(self.known)
        for _, path, inode, size in sorted(files):
            had = out.get(path)
            if had is None and self.tail:
                end = _last_line_end(path, 0, size)
                out[path] = {"inode": inode, "life": 0, "base": end, "pos": end}
                continue
            if had is None or had["inode"] != inode or had["pos"] > size:
                had = {"inode": inode, "life": had["life"] + 1 if had else 0, "base": 0, "pos": 0}
            if left > 0 and time.monotonic() < until:
                most = min(left, self.lines_each if self.lines_each is not None else float("inf"))
                if most == float("inf"):
                    pos = _last_line_end(path, had["pos"], size)
                else:
                    pos, taken = _after_lines(path, had["pos"], size, int(most), until)
                    left -= taken
                had = had | {"pos": pos}
            out[path] = had
        self._promise(out)
        return out

    def _promise(self, offset: dict) -> None:
        self.known = offset
        if self.cursor:
            fresh = f"{self.cursor}.{os.getpid()}"
            with open(fresh, "w", encoding="utf-8") as f:
                json.dump(offset, f)
            os.replace(fresh, self.cursor)

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for path, now in sorted(end.items()):
            had = start.get(path)
            same = had is not None and (had["inode"], had["life"]) == (now["inode"], now["life"])
            first = had["pos"] if same else now["base"]
            for at in range(first, now["pos"], RANGE):
                out.append(Span(path, now["inode"], first, at, min(at + RANGE, now["pos"]), now["pos"]))
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        path = _place(partition.path, partition.inode)
        if path is None:
            return
        with open(path, "rb") as f:
            at = partition.begin
            if at > partition.first:
                # the line that the range before this one ends with is its own
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < partition.end:
                raw = f.readline(partition.stop - at)
                if not raw:
                    break
                line = raw.rstrip(b"\r\n").decode("utf-8", "replace")
                yield partition.path, partition.inode, at, at + len(raw), line
                at += len(raw)


def _place(path: str, inode: int) -> str | None:
    """Where the file of this inode is now: renamed by a rotation, it is beside its
    old path; null once it is gone."""
    folder = os.path.dirname(path)
    for name in [path, *(os.path.join(folder, n) for n in sorted(os.listdir(folder)))]:
        try:
            if os.stat(name).st_ino == inode:
                return name
        except FileNotFoundError:
            continue
    return None


class LogTail(DataSource):
    """See the module; rows are (path, inode, start, stop, line)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))
