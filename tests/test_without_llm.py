"""The library without its subpackage for training data."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_entry_imports_without_the_subpackage(tmp_path, also):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *also))
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 100 and not any(q.startswith('op') and q[2].isdigit() for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": str(tmp_path / "copy")}, check=True)


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "kinescribe").rglob("*.py"):
        assert "llm" in path.parts or "kinescribe.llm" not in path.read_text()
