"""A copy of the repository without the llm folders and the pipeline still imports, registers and answers."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

SCRIPT = """
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 70 and names >= set(e.oracle_sql()) and not any(n.startswith("op") or n == "pipeline" for n in names), names
assert {n for n in names if n.startswith("q_")} == names
"""


def test_imports_without_llm(tmp_path):
    skip = shutil.ignore_patterns(".git", "llm", "__pycache__", "corpus_pipeline.py", "*.json")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    assert not (tmp_path / "copy/lograil/llm").exists() and not (tmp_path / "copy/tests/llm").exists()
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
