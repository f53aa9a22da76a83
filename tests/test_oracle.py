"""Every query with SQL against DuckDB on the smallest tables, the others for rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op")}
ROWS = [k for k in entry.queries() if k not in entry.oracle_sql() and not k.startswith("op") and k != "pipeline"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    return c


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda x: "null" if x is None else round(float(x), 5) + 0.0 if not isinstance(x, (str, bool)) and hasattr(x, "__float__") else str(x)
    return sorted(str([cell(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    df = entry.queries()[name](spark, DIR)
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(found.fetchall(), names)


@pytest.mark.parametrize("name", sorted(ROWS))
def test_gives_rows(spark, name):
    assert entry.queries()[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
