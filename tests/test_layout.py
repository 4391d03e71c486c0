"""The engine without the optional subpackage."""

from __future__ import annotations

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_imports_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT / "trialspark", tmp_path / "trialspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True, timeout=120)


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "trialspark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "trialspark.llm" not in path.read_text(), path
