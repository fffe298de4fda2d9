"""The rest of the repository works without the training-data subpackage and its pipeline."""

import os
import re
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
KEPT = ("sparrowdex", "tests", "eval", "__spark_entry__.py", "bench.py")


@pytest.fixture(scope="module")
def rest(tmp_path_factory):
    at = tmp_path_factory.mktemp("rest")
    for name in KEPT:
        src = os.path.join(ROOT, name)
        if os.path.isdir(src):
            shutil.copytree(src, at / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(src):
            shutil.copy(src, at / name)
    return at


def python(at, *args):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, *args], cwd=at, env=env, capture_output=True, text=True)


def test_entry_imports_without_the_subpackage(rest):
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_topk' in q and not [k for k in q if k.startswith('op') or k == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    done = python(rest, "-c", code)
    assert done.returncode == 0, done.stderr
    # nothing outside names it
    for folder, _, names in os.walk(rest / "sparrowdex"):
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n)) as f:
                    assert not re.search(r"\bllm\b", f.read())


def test_remaining_tests_pass_without_it(rest):
    """All of them are collected; those of parsers, the command line and some queries are run here."""
    collected = python(rest, "-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider")
    assert collected.returncode == 0, collected.stdout
    some = ["tests/test_chunking.py", "tests/test_cli.py::test_flags", "tests/test_queries.py", "-k", "not create_chunks and not query or bm25_topk or neighbor or prompt_text"]
    done = python(rest, "-m", "pytest", *some, "-q", "-p", "no:cacheprovider")
    assert done.returncode == 0, done.stdout[-3000:]


def test_a_broken_module_is_not_passed_over(rest, tmp_path):
    shutil.copytree(rest / "sparrowdex", tmp_path / "sparrowdex")
    shutil.copy(rest / "__spark_entry__.py", tmp_path)
    (tmp_path / "sparrowdex" / "llm").mkdir()
    assert python(tmp_path, "-c", "import __spark_entry__").returncode == 0  # an empty folder is no package
    (tmp_path / "sparrowdex" / "llm" / "__init__.py").write_text("")
    (tmp_path / "sparrowdex" / "llm" / "queries.py").write_text("import nothing_of_this_name")
    assert "nothing_of_this_name" in python(tmp_path, "-c", "import __spark_entry__").stderr
