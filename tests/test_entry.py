"""The entry in a program of its own: with everything, without the optional part, and without the modules that part needs."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
OPTIONAL = os.path.isdir(f"{ROOT}/scorelark/llm")


def names(root, before=""):
    code = f"{before}\nimport __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(n for n in e.queries() if n.startswith('op') or n == 'pipeline'))"
    return subprocess.run([sys.executable, "-W", "always", "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": str(root)}, capture_output=True, text=True, timeout=120)


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(f"{ROOT}/scorelark", tmp_path / "scorelark", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    return tmp_path


def test_without_the_optional_part(copy):
    got = names(copy)
    assert got.returncode == 0 and got.stdout.strip().endswith("[]") and "without" not in got.stderr


@pytest.mark.skipif(not OPTIONAL, reason="the optional part isn't there")
def test_without_a_module_of_others():
    everything, less = names(ROOT), names(ROOT, "import sys; sys.modules['public_tokenizers'] = None")
    assert everything.returncode == 0 and "pipeline" in everything.stdout
    assert less.returncode == 0 and less.stdout.strip().endswith("[]") and "no module public_tokenizers" in less.stderr


def test_errors_inside_the_optional_part_show(copy):
    (copy / "scorelark/llm").mkdir()
    (copy / "scorelark/llm/__init__.py").write_text("")
    (copy / "scorelark/llm/entries.py").write_text("from . import gone_missing_part\nimport scorelark.llm.nowhere\n")
    (copy / "corpus_pipeline.py").write_text("")
    assert names(copy).returncode != 0
