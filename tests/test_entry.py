"""The rest of the repository without the training-data folders and the pipeline."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def run(where: Path, *command: str) -> str:
    env = os.environ | {"PYTHONPATH": str(where), "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, *command], cwd=where, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stdout[-2000:] + done.stderr[-2000:]
    return done.stdout


def copy(to: Path) -> Path:
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse"))
    return to


def test_entry_without_the_training_data_folders(tmp_path):
    where = copy(tmp_path / "copy")
    assert not (where / "waymark/llm").exists()
    script = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), 'pipeline' in q, any(k.startswith('op1_') for k in q))"
    n, m, pipeline, training = run(where, "-c", script).split()
    assert int(n) > 100 and int(m) > 100 and pipeline == training == "False"


def test_the_remaining_tests_are_found_without_them(tmp_path):
    where = copy(tmp_path / "copy")
    (where / "corpus_pipeline.py").unlink(missing_ok=True)
    found = run(where, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider")
    assert "error" not in found.lower() and "test_catalog.py" in found
    run(where, "-m", "pytest", "tests/test_catalog.py", "-q", "-p", "no:cacheprovider", "-k", "oracles_have_queries or test_entry")


def test_nothing_else_imports_the_training_data_operators():
    for p in (ROOT / "waymark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "waymark.llm" not in p.read_text(), p
