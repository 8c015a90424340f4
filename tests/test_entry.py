"""The entry module with the training-data subpackage and its pipeline taken away."""

import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

ABSENT = shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache")
SCRIPT = """
import __spark_entry__ as entry
from kerbline.session import build_session
names = set(entry.queries())
assert len(names) > 80 and not any(n.startswith("op") for n in names) and "pipeline" not in names
assert set(entry.oracle_sql()) <= names
spark = build_session("entry", "local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
assert entry.queries()[entry.FLAGSHIP](spark, DIR).count() > 0
spark.stop()
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_rest_works_without_the_subpackage(small_sf, tmp_path, pipeline):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=ABSENT)
    if not pipeline:
        (tmp_path / "copy/corpus_pipeline.py").unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-c", f"DIR = {small_sf!r}\n{SCRIPT}"], cwd=tmp_path / "copy", capture_output=True, text=True,
                          env=os.environ | {"PYTHONPATH": str(tmp_path / "copy")}, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
