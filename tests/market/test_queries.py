"""Every query with SQL against DuckDB on the driver's smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(float(v) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not DATA.exists(), reason="driver tables")
@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(plain(v) for _, v in sorted(zip(columns, r, strict=True))) for r in found.fetchall())
    got = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect())
    assert got == want


@pytest.mark.skipif(not DATA.exists(), reason="driver tables")
@pytest.mark.parametrize("name", [k for k in entry.registry.queries() if k not in SQL])
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, str(DATA)).count() > 0
