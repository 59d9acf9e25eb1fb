"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are gathered from all labelled rows where the partitions are and summed;
the log-probability matrix has a fixed number of buckets a language and is
broadcast.  Documents are scored in numpy as sparse count vectors times that
matrix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets that n-grams are hashed to, and the lengths of n-grams.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Languages that one model can hold; bounds the broadcast matrix (4 bytes a cell).
MOST_LANGUAGES = 500
#: Languages that a worker counts at a time, and what is added to each count.
HELD, SMOOTH = 64, 0.1
#: Characters scored at a time.
SLICE = 1 << 18

_ASCII_LETTER = re.compile("[A-Za-z]")
_LETTER = regex.compile(r"\p{L}")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text) or _LETTER.search(text))


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a whole text, in slices that overlap."""
    low = text.lower()
    widest = max(ORDERS)
    for at in range(0, max(1, len(low)), SLICE):
        part = low[max(0, at - widest + 1) : at + SLICE]
        back = min(at, widest - 1)
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for n in ORDERS:
            skip = back - (n - 1) if at else 0
            own = c[skip:]
            h = np.full(max(0, len(own) - n + 1), n, dtype=np.uint32)
            for k in range(n):
                h = (h ^ own[k : k + len(h)]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            yield (h & np.uint32(BUCKETS - 1)).astype(np.int32)


def _held_out(doc_id: str) -> str:
    return f"pmod(crc32(cast({doc_id} AS string)), 4) = 2"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, count) of a partition; a worker holds HELD languages at a time."""
    by: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, own in by.items():
            k = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), type=pa.string()), pa.array(k.astype(np.int32)), pa.array(own[k])], names=["lang", "bucket", "c"])

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
            if lang not in by and len(by) >= HELD:
                yield from rows()
                by.clear()
            own = by.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
            for g in grams(text.as_py()):
                if len(g) > BUCKETS // 8:
                    own += np.bincount(g, minlength=BUCKETS)
                else:
                    np.add.at(own, g, 1)
    yield from rows()


def _logs(table: pa.Table) -> pa.Table:
    """A language's row of the matrix, from its counts (at most BUCKETS rows)."""
    own = np.zeros(BUCKETS)
    own[table.column("bucket").to_numpy()] = table.column("c").to_numpy()
    logs = np.log(own + SMOOTH) - np.log(own.sum() + SMOOTH * BUCKETS)
    return pa.table({"lang": table.column("lang")[:1], "logs": pa.array([logs.astype(np.float32).tobytes()], type=pa.binary())})


def train(rows: DataFrame, most: int = MOST_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages in order and the matrix [bucket, language] of log probabilities.

    ``rows``: text, lang.  Training reads every row; a language is one row of
    BUCKETS numbers, whatever the corpus.  More than ``most`` languages raise an
    error before anything is counted: the labels are then no languages.
    """
    found = rows.select("lang").distinct().limit(most + 1).count()
    if found > most:
        raise ValueError(f"more than {most} languages, which the model holds")
    sums = rows.mapInArrow(_counts, "lang string, bucket int, c long").groupBy("lang", "bucket").agg(F.sum("c").alias("c"))
    table = sums.groupBy("lang").applyInArrow(_logs, "lang string, logs binary").orderBy("lang").toArrow()
    logs = [np.frombuffer(x.as_buffer(), dtype=np.float32) for x in table.column("logs")]
    return table.column("lang").to_pylist(), np.stack(logs, axis=1) if logs else np.zeros((BUCKETS, 0), dtype=np.float32)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from rows with text and lang whose crc32(doc_id) mod 4 is not 2, with
    the same prior for each language.  The score is the posterior of the
    average n-gram evidence, so it doesn't saturate with length.  ``und`` (score
    0) when the text is null or has no letter, or nothing could be learned.  Of
    languages that score alike the first in code-point order is predicted.  Rows
    may repeat: each is counted in training and answered; other columns are
    ignored.  A null id is learned from.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = rows.filter(f"text IS NOT NULL AND lang IS NOT NULL AND NOT coalesce({_held_out('doc_id')}, false)")
    langs, logs = train(known.select("text", "lang"))
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            pred, score = [], []
            for x in batch.column(2):
                text = x.as_py()
                if text is None or not langs or not has_letter(text):
                    pred.append("und")
                    score.append(0.0)
                    continue
                total, n = np.zeros(len(langs)), 0
                for g in grams(text):  # a sparse count vector times the matrix
                    at, times = np.unique(g, return_counts=True)
                    total += times @ model[at]
                    n += len(g)
                best = int(np.argmax(total))
                scaled = np.exp((total - total[best]) / max(1.0, n / 20))
                pred.append(langs[best])
                score.append(float(scaled[best] / scaled.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, type=pa.string()), pa.array(score, type=pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    asked = rows.select("doc_id", F.coalesce(F.expr(_held_out("doc_id")), F.lit(False)).alias("held_out"), "text")
    return asked.mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
