"""Every registered query against its SQL on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest

from checks import load_all
from checks.verify import compare, connect

FOLDER = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(load_all()))
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, name, load_all()[name]) == ""


def test_driver_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["status", "code", "diff_count", "right_group_rows"]


def test_queries_load_without_the_text_package(tmp_path):
    """A copy without the two llm folders still offers all other queries."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert 'pipeline' not in q; print(len(q))"
    got = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    assert int(got.stdout) == len(load_all())
