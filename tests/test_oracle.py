"""Every registered query against its SQL counterpart in DuckDB, on the same tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from textwarden.plans import oracle
from textwarden.plans import queries as plans

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
ORACLE = oracle.sql()
QUERIES = plans.registry()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def test_all_have_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, FOLDER)
    got = [tuple(row) for row in result.collect()]
    answer = duck.execute(ORACLE[name])
    columns = [column[0] for column in answer.description]
    want = answer.fetchall()
    assert sorted(result.columns) == sorted(columns)
    assert len(got) == len(want)
    assert rows_of(result.columns, got) == rows_of(columns, want)

