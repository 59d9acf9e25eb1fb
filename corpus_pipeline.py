"""A training corpus from raw documents: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.  Null and empty texts
go at the first stage, as too short; very long ones are read whole.  Ids may
repeat: a row goes or stays by its own id and text.  Further columns pass
through, whatever their names, up to packing.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engram.llm.best_fit_packing import pack
from engram.llm.exact_dedup import drop_copies
from engram.llm.ngram_jaccard_join import one_of_each
from engram.llm.quality_rules import keep_good
from engram.llm.queries import tokenizer_path
from engram.llm.source_mixing import repeat_rows
from engram.llm.storage import durable, release, tables
from engram.sources.views import spread


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go, null and empty texts among them."""
    return keep_good(docs)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null is empty), one row with the largest id stays."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, one row with the least id stays; texts without
    words are copies of nothing."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources (null is one) takes it; texts without
    words are not taken."""
    return repeat_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 tokens; every row is packed."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality),
    ("exact dedup", copies),
    ("near copies", near_copies),
    ("source mixing", mixing),
    ("packing", packing),
]

#: SQL can't express mixing and packing; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; a stage's tables go once it is written."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    before = None
    for name, stage in STAGES:
        with tables() as keep:
            docs = keep(durable(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        if before is not None:
            release(before)
        before = docs
    return docs
