"""The entry point where optional parts are missing."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print('QUERIES', *sorted(q))"


def names(folder):
    run = subprocess.run([sys.executable, "-B", "-c", SHOW], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-1500:]
    return set(run.stdout.rpartition("QUERIES")[2].split())


@pytest.fixture
def copied(tmp_path):
    for name in ("sparkloom", "__spark_entry__.py"):
        whole = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(whole) else shutil.copy)(whole, tmp_path / name)
    shutil.rmtree(tmp_path / "sparkloom" / "llm", ignore_errors=True)
    return tmp_path


def test_queries_without_the_optional_folder(copied):
    from sparkloom import queries

    assert names(copied) == set(queries.queries())


def test_a_top_level_module_that_needs_the_folder_goes_with_it(copied):
    (copied / "corpus_pipeline.py").write_text("from sparkloom.llm import common\n")
    assert "tpch_q1_like" in names(copied)


def test_other_errors_are_shown(copied):
    (copied / "corpus_pipeline.py").write_text("import no_such_module_of_anyone\n")
    with pytest.raises(AssertionError, match="no_such_module_of_anyone"):
        names(copied)
