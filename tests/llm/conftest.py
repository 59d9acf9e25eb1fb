import pytest
from pyspark.sql import functions as F


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, extra clashing columns."""
    base = " ".join(f"word{k}" for k in range(80))
    rows = [
        (1, base, "en", "a"), (2, base.upper(), "en", "a"), (3, base + " tail", "en", None), (4, None, None, "b"), (5, "", "fr", "b"),
        (6, " \t\n", None, "b"), (7, "one two", "de", "c"), (8, "One TWO", "de", "c"), (9, "le la les " * 3000, "fr", "a"),
        (10, "x", "xx", "a"), (10, "x", "xx", "a"), (None, "no id at all", "en", "a"), (11, "é" * 5, "fr", "d"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumns({"n": F.lit(0), "size": F.lit("s"), "kept": F.lit(1), "token": F.lit("t"), "sha": F.lit(None).cast("string")})


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
