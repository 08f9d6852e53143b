"""Every registered query with an oracle against DuckDB on the smallest tables; the others return rows of one schema."""

import datetime
import decimal
import math

import duckdb
import pytest

from marlstone.plans import catalog
from marlstone.plans.stand_ins import DRIVER

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in DRIVER:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def plain(v):
    if isinstance(v, (decimal.Decimal, float)):
        v = float(v)
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equal_duckdb(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(*cols).collect()), key=repr)
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(([plain(r[i]) for i in order] for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows_only(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns and len(df.collect()) >= (0 if name in ("size_guard", "windowed_counts") else 1)
