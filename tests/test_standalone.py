"""The engine without the subpackage for training data."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as e
found = e.queries()
assert len(found) > 150 and set(e.oracle_sql()) <= set(found)
assert "pipeline" not in found and not any(q.startswith("op") and q[2].isdigit() for q in found)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(spark).count() > 0
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    shutil.copytree(ROOT / "engram", tmp_path / "engram", ignore=lambda d, names: {"llm", "__pycache__"} & set(names))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline:
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
