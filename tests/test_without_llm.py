"""The library without its llm subpackage: a copy of the tree with the folders taken out."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAYS = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
from sieveline.plans import catalog
assert set(e.queries()) == set(catalog.queries()) and len(e.queries()) > 60, len(e.queries())
assert set(e.oracle_sql()) == set(catalog.oracle_sql())
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", e.entry(spark).count())
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_llm(tmp_path, pipeline):
    gone = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(ROOT, tmp_path / "copy", ignore=gone)
    said = subprocess.run([sys.executable, "-c", SAYS], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=240)
    assert said.returncode == 0, said.stderr[-2000:]
    assert "rows 1" in said.stdout
