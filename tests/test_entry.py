"""The driver's entry, with and without the operators for training data."""

import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_query_is_listed():
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known) and "source_scorecard" in known


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_the_llm_folders(tmp_path):
    for pipeline in (True, False):
        copy = tmp_path / str(pipeline)
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *(() if pipeline else ("corpus_pipeline.py",))))
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)})
        assert said.returncode == 0, said.stderr
        assert int(said.stdout.split()[0]) > 50 and "op" not in said.stderr
