"""Every query against its SQL, on the smallest data."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from pulselake.gallery import load

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load().QUERIES, load().ORACLES


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def _rows(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted([tuple(str(r[i]) for i in order) for r in rows])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, got) == _rows(columns, cursor.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(entry_points.queries())), str(len(entry_points.oracle_sql()))], done.stderr
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())
