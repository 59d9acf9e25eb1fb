"""Intermediate tables that survive the loss of an executor.

A cut in the lineage is a Parquet table under ``spark.checkpoint.dir`` (the
folder all executors share).  Only where that setting is absent and Spark runs on
this machine alone, as in tests, a temporary folder is used.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []
#: What ``durable`` wrote in the innermost run of this thread (see ``tables``).
_RUN: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("run", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session, or a local one for a local session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="engram-"))
    return "file://" + _LOCAL[0]


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of this application's in the shared one, not yet there."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    own = _RUN.get()
    if own is not None:
        own.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _folders(df: DataFrame) -> set[str]:
    """Last part of the folders that ``df`` reads."""
    return {name.rsplit("/", 2)[1] for name in df.inputFiles()}


def release(df: DataFrame) -> None:
    """Delete a table that ``durable`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    app = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    for name in _folders(df):
        delete_folder(spark, f"{app}/{name}")


@contextmanager
def tables() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A run: at its end the tables that it wrote go, but for those that a frame
    given to ``keep`` reads; these belong to the run around it, if there is one.

        with tables() as keep:
            out = keep(durable(steps(docs)))

    Runs of other threads have lists of their own.
    """
    outer, own, kept = _RUN.get(), [], []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    mark = _RUN.set(own)
    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        _RUN.reset(mark)
        stay = set().union(*[_folders(df) for df in kept])
        for spark, path in own:
            if path.rsplit("/", 1)[1] not in stay:
                delete_folder(spark, path)
            elif outer is not None:
                outer.append((spark, path))
