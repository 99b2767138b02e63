"""The registered queries with and without the pipeline subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
COUNT = "import re, __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if re.match(r'op\\d+_|pipeline$', n)])"


@pytest.mark.parametrize("gone", [("embertrace/llm", "tests/llm"), ("embertrace/llm", "tests/llm", "corpus_pipeline.py")])
def test_import_without_the_subpackage(tmp_path, gone):
    skip = shutil.ignore_patterns(".git", "__pycache__", "*.pyc", *(Path(g).name for g in gone))
    shutil.copytree(REPO, tmp_path / "copy", ignore=skip)
    run = subprocess.run([sys.executable, "-B", "-c", COUNT], cwd=tmp_path / "copy", capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    count, names = run.stdout.split(maxsplit=1)
    assert int(count) > 150 and names.strip() == "[]"
