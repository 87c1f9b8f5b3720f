"""The entry point's contract, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50
    assert all(callable(q) for q in queries.values())


def test_nothing_else_imports_the_llm_subpackage():
    for p in (ROOT / "marketweave").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "marketweave.llm" not in p.read_text()


def test_entry_without_the_llm_folders(tmp_path):
    shutil.copytree(ROOT / "marketweave", tmp_path / "marketweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 50 and not [n for n in q if n.startswith('op') or n == 'pipeline']; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
