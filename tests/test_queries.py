"""Every registered query against its expected result in DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


def plain(v):
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    if name not in entry.oracle_sql():
        assert rows
        return
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=key)
    assert rows == want


@pytest.mark.parametrize("name,most", [("period_totals", 4), ("usage_panel", 6), ("session_snapshots", 5), ("card_view", 4), ("logical_sessions", 3)])
def test_scans_of_the_first_plan(spark, name, most):
    """Plans must not read their input again for each branch."""
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") <= most
