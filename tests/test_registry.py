"""Every registered query against its SQL on the same tables."""

import os
import shutil
import subprocess
import sys

import pytest
from compare import connect, differences

import __spark_entry__ as contract
from conftest import SF_SMALL
from eventloom.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF_SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert QUERIES.items() <= contract.queries().items() and ORACLES.items() <= contract.oracle_sql().items()


def test_entry(spark):
    assert contract.entry(spark).columns[:2] == ["bucket", "total"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert differences(QUERIES[name](spark, SF_SMALL), con, ORACLES[name]) == ""


def test_imports_without_the_text_operators(tmp_path):
    home = os.path.dirname(os.path.abspath(contract.__file__))
    without = lambda folder, names: [n for n in names if n in ("llm", ".git", "__pycache__")]
    for name in ("eventloom", "tests"):
        shutil.copytree(f"{home}/{name}", f"{tmp_path}/{name}", ignore=without)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{home}/{name}"):
            shutil.copy(f"{home}/{name}", f"{tmp_path}/{name}")
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) == set(e.queries()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
