"""The entry module without the optional training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("without", [("lodestone/llm", "tests/llm"), ("lodestone/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_without_optional_folders(tmp_path, without):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in without:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sorted(set(e.oracle_sql()) - set(q)), [n for n in q if n.startswith('op') or n == 'pipeline'])"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    from lodestone.plans.catalogue import QUERIES

    assert said.stdout.strip() == f"{len(QUERIES)} [] []"
