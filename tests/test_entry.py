"""The entry in copies of the repository that lack the optional parts."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [["vellum/llm", "tests/llm"], ["vellum/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_optional_parts(tmp_path, gone):
    kept = lambda folder, names: [n for n in names if n.startswith(".") or n == "__pycache__" or os.path.relpath(os.path.join(folder, n), ROOT) in gone]
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=kept)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op') and n[2].isdigit() for n in q), set(e.oracle_sql()) <= set(q), 'scan_documents' in q)"
    env = {**os.environ, "PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, pipeline, numbered, covered, flagship = out.stdout.split()
    has_llm = (ROOT / "vellum" / "llm").exists() and "vellum/llm" not in gone
    assert (pipeline, numbered, covered, flagship) == ("False", str(has_llm), "True", "True") and int(n) >= 60
