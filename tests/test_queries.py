"""Registered queries against their SQL, on the smallest tables."""

import re
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check_queries import TABLES, rows_of  # noqa: E402


@pytest.fixture(scope="module")
def database(folder):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


# The corpus queries have tests of their own.
NAMES = [n for n in sorted(entry.oracle_sql()) if not re.match(r"op\d+_|pipeline", n)]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, folder, database, name):
    df = entry.queries()[name](spark, folder)
    done = database.execute(entry.oracle_sql()[name])
    names = [d[0] for d in done.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, done.fetchall())
    plan = df._jdf.queryExecution().toString()
    assert not any(n in plan for n in ("EvalPython", "InPandas", "InArrow", "CartesianProduct"))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
