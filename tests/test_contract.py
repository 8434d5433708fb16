"""The driver contract with and without its optional parts."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
HIDE = "import sys; sys.modules.update({{name: None for name in {hidden!r}}}); "
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.QUERIES), set(e.oracle_sql()) <= set(e.queries()))"


@pytest.mark.parametrize("hidden", [["reasonloom.llm"], ["reasonloom.llm", "corpus_pipeline"], ["corpus_pipeline"]])
def test_optional_modules_may_be_absent(hidden):
    code = HIDE.format(hidden=hidden) + SAY
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    n_all, n_own, oracle_fits = done.stdout.split()
    assert oracle_fits == "True"
    there = (ROOT / "reasonloom" / "llm").is_dir() and "reasonloom.llm" not in hidden
    assert (int(n_all) > int(n_own)) == there


@pytest.mark.parametrize("hidden", [["zstandard"], ["public_tokenizers"], ["xxhash"]])
def test_the_library_stands_without_the_imports_of_optional_modules(hidden):
    code = HIDE.format(hidden=hidden) + SAY
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    n_all, n_own, oracle_fits = done.stdout.split()
    assert n_all == n_own and oracle_fits == "True"
    if (ROOT / "reasonloom" / "llm").is_dir():
        assert "left out reasonloom.llm.queries" in done.stderr and hidden[0] in done.stderr


def test_errors_inside_present_modules_are_raised(tmp_path):
    code = HIDE.format(hidden=["numpy"]) + SAY
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode != 0


def test_the_library_does_not_need_the_optional_parts():
    for path in (ROOT / "reasonloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "reasonloom.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()
