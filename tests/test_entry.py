"""The entry module with and without the training-data operators."""

import importlib.util
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_training_data_folders(tmp_path, pipeline):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *[] if pipeline else ["corpus_pipeline.py"]))
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q), any(x.startswith('op') and x[2].isdigit() or x == 'pipeline' for x in q))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, training = done.stdout.split()
    assert int(n) > 80 and training == "False"


def test_keys_of_sql_are_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if importlib.util.find_spec("timberline.llm"):
        assert "pipeline" in entry.queries()
