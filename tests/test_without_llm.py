"""The library stands without the subpackage for training data and the pipeline that is built on it."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_the_rest_imports_and_registers(tmp_path):
    for name in ("quarrystat", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 150
    assert said[1:] == ["False", "False"]


def test_nothing_else_imports_it():
    for path in (ROOT / "quarrystat").rglob("*.py"):
        if "llm" not in path.parts:
            assert "quarrystat.llm" not in path.read_text()
