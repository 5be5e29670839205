"""Every registered query against its SQL, over whole tables."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)
    result = duck.execute(ORACLE[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    assert got == sorted(expected, key=repr)
    assert got


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_entry_points_without_the_operators_for_training_data():
    """They may be left out, but what they need may not be missing without a word."""
    code = "import sys; sys.modules['{}'] = None; import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()))"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("corpus_pipeline", "logweft.llm"):
        done = subprocess.run([sys.executable, "-c", code.format(name)], cwd=root, capture_output=True, text=True)
        assert done.stdout.strip() == "True", done.stderr
    if os.path.exists(os.path.join(root, "corpus_pipeline.py")):
        done = subprocess.run([sys.executable, "-c", code.format("ahocorasick")], cwd=root, capture_output=True, text=True)
        assert done.returncode and "ahocorasick" in done.stderr
