"""The driver's module with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PROGRAM = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'bm25_topk' in q; print(*sorted(q))"


def names(root: Path) -> set[str]:
    got = subprocess.run([sys.executable, "-c", PROGRAM], cwd=root, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    return set(got.stdout.split())


@pytest.mark.parametrize("gone", [["evidentia/llm"], ["evidentia/llm", "corpus_pipeline.py"]])
def test_without_training_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    for name in gone:
        shutil.rmtree(copy / name, ignore_errors=True) if (copy / name).is_dir() else (copy / name).unlink(missing_ok=True)
    left = names(copy)
    assert "pipeline" not in left and not {n for n in left if n.startswith("op") and n[2].isdigit()}
