"""The corpus subpackage can be taken out: nothing else imports it, and the entry module works without it."""

from __future__ import annotations

import ast
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def imported(path: Path) -> set[str]:
    names = set()
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            names |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            names |= {node.module, *(f"{node.module}.{a.name}" for a in node.names)}
    return names


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "quantspark").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "quantspark").parts:
            assert not [n for n in imported(path) if n.startswith(("quantspark.llm", "corpus_pipeline"))], path


def test_entry_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT / "quantspark", tmp_path / "quantspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') and n[2].isdigit()] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
