"""Queries against their SQL on inputs that the driver's smallest tables don't have."""

import math
import random
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from test_queries import DATA, SQL, plain

import __spark_entry__ as entry
from tideledger.operators import joins


def equal(spark, name: str, at: Path) -> tuple[list, list]:
    """Columns and rows of the SQL over the tables in ``at``, which are those of the query."""
    con = duckdb.connect()
    for f in at.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = entry.queries()[name](spark, str(at))
    found = con.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(plain(v) for _, v in sorted(zip(columns, r, strict=True))) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()) == want
    return sorted(columns), want


@pytest.mark.skipif(not DATA.exists(), reason="driver tables")
@pytest.mark.parametrize("events", ["event_id % 3 > 0 AND value < 60", "false"])
def test_rules_that_never_fire_have_no_windows(spark, tmp_path, events):
    duckdb.connect().execute(f"COPY (SELECT * FROM '{DATA}/events.parquet' WHERE {events}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    columns, want = equal(spark, "event_return_windows", tmp_path)
    at = columns.index("rule")
    assert len({r[at] for r in want}) < 11


@pytest.mark.parametrize("cells", [(1 << 16, 1 << 20), (3, 5), (1, 1)])
def test_interval_sums_are_those_of_all_pairs(spark, cells):
    rng = random.Random(5)
    places = [float(rng.randrange(40)) for _ in range(150)] + [rng.uniform(-5, 45) for _ in range(50)] + [-0.0, 1e300, -1e300, math.inf, -math.inf, None]
    points = [(x, rng.choice([None, rng.uniform(-9, 9), rng.uniform(-9, 9)])) for x in places] + [(7.0, math.inf), (30.5, -math.inf), (33.5, math.nan), (20.5, None), (60.0, None)]
    spans = [(rng.randrange(60), a, a + rng.choice([0, 0.5, 3, 20, 100])) for a in (rng.uniform(-10, 50) for _ in range(150))] + [(rng.randrange(60), 7.0, 9.0) for _ in range(40)]
    spans += [(70, -math.inf, math.inf), (71, 20.2, 20.6), (72, 59.0, 61.0), (73, 6.5, 7.0), (74, 30.0, 31.0), (75, None, 3.0), (76, 3.0, None), (77, 9.0, 8.0), (78, 5.0, math.nan), (None, 1.0, 20.0), (79, -1.0, 0.0)]
    want = defaultdict(list)
    for k, a, b in spans:
        if None not in (a, b) and b == b:
            want[k] += [v for x, v in points if x is not None and a < x <= b]
    rng.shuffle(points)
    got = joins.interval_sums(spark.createDataFrame(points, "x double, v double"), "x", "v", spark.createDataFrame(spans, "k long, lo double, hi double"), "lo", "hi", "k", *cells)
    got = {r["k"]: (r["n"], r["total"]) for r in got.collect()}
    assert set(got) == {k for k, met in want.items() if met}
    for k, (n, total) in got.items():
        there = [v for v in want[k] if v is not None]
        assert n == len(want[k])
        assert total == pytest.approx(sum(there), abs=1e-9, nan_ok=True) if there else total is None
    none = joins.interval_sums(spark.createDataFrame([], "x double, v double"), "x", "v", spark.createDataFrame(spans, "k long, lo double, hi double"), "lo", "hi", "k", *cells)
    assert none.count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="driver tables")
def test_interval_index_forms_no_pairs(spark, tmp_path):
    """Lines span a day, the points stand within minutes of it: rows that leave a plan's parts grow with both tables, not with their product."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (TIMESTAMP '2024-01-09 00:00:00' + to_microseconds(CAST(event_id AS BIGINT) * 1000000) AS ts) FROM '{DATA}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT * REPLACE (CAST(row_number() OVER () AS BIGINT) AS l_orderkey, CAST(0 AS BIGINT) AS l_partkey, CAST(6 AS INTEGER) AS l_linenumber, 400.0::DOUBLE AS l_quantity) FROM '{DATA}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    columns, want = equal(spark, "interval_index", tmp_path)
    assert len(want) > 100
    plan = entry.queries()["interval_index"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "NestedLoop" not in plan
