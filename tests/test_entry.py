"""The driver contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).parents[1]


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) > 50 and set(oracles) <= set(queries) and len(oracles) > 45


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


CODE = "import __spark_entry__ as e; q = e.queries(); assert 'search_many' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py")])
def test_works_without_the_optional_parts(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", *gone))
    done = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=tmp_path / "r", env=os.environ | {"PYTHONPATH": str(tmp_path / "r")}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_works_without_a_library_of_the_optional_parts(tmp_path):
    code = f"import sys; sys.modules['xxhash'] = None; {CODE}"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
