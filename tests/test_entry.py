"""The entry without its optional part, in a copy of the repository."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"


def entry_of(folder: Path) -> list[str]:
    env = os.environ | {"PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", SHOW], cwd=folder, env=env, check=True, capture_output=True, text=True).stdout.split()


def copy(tmp_path, *without: str) -> Path:
    to = tmp_path / "copy"
    shutil.copytree(REPO, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.md", "*.json"))
    for name in without:
        at = to / name
        shutil.rmtree(at, ignore_errors=True) if at.is_dir() else at.unlink(missing_ok=True)
    return to


def test_entry_without_the_corpus_operators(tmp_path):
    count, _, theirs = entry_of(copy(tmp_path, "rankloom/llm", "tests/llm"))  # corpus_pipeline.py stays behind
    assert int(count) > 0 and theirs == "False"


def test_entry_without_the_corpus_operators_and_the_pipeline(tmp_path):
    to = copy(tmp_path, "rankloom/llm", "tests/llm", "corpus_pipeline.py")
    (to / "rankloom/llm/__pycache__").mkdir(parents=True)  # what an interpreter leaves of a deleted package
    count, _, theirs = entry_of(to)
    assert int(count) > 0 and theirs == "False"


def test_nothing_else_imports_the_corpus_operators():
    for path in (REPO / "rankloom").rglob("*.py"):
        if "llm" not in path.relative_to(REPO).parts:
            assert "rankloom.llm" not in path.read_text() and "from ..llm" not in path.read_text()
