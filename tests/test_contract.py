"""Contract queries against their SQL in DuckDB, at the smallest scale factor."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

from shoalgrid.plans import contract

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, Decimal):
        return float(f"{float(v):.8g}")
    return str(v)[:19] if hasattr(v, "isoformat") else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows_of(df.columns, df.collect()), rows_of(columns, found.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, rel=1e-6, abs=1e-6, nan_ok=True) if all(isinstance(x, (int, float)) for x in (*a, *b)) else a == b


@pytest.mark.parametrize("name", ["job_coastal_change", "predict_cells_forest", "osw_cluster", "huber_depth_correction"])
def test_gives_rows(spark, name):
    """Queries without SQL whose parts are tested elsewhere have rows, and every row a value."""
    rows = QUERIES[name](spark, DATA).collect()
    assert rows and all(v is not None for r in rows for v in r)
