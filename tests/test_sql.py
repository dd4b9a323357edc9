"""Every query that has SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


def cell(x):
    if isinstance(x, float):
        return "nan" if x != x else f"{x:.4f}".replace("-0.0000", "0.0000")
    if isinstance(x, (list, tuple)):
        return str([cell(y) for y in x])
    if isinstance(x, dict):
        return str([cell(y) for y in x.values()])
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF_DIR}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith("op")))
def test_query_equals_its_sql(spark, duck, name):
    found = entry.queries()[name](spark, SF_DIR)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(columns, want.fetchall())
