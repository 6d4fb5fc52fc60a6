"""Every registered reference query against its SQL in DuckDB, over whole small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from helixframe.catalog import everything

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in DATA.iterdir():
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([shown(x) for x in v])
    if isinstance(v, (str, bool)):
        return str(v)
    try:
        return f"{float(v):.6g}"
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(everything.ORACLES))
def test_query_equals_its_sql(spark, tables, name):
    got = everything.QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    want = tables.execute(everything.ORACLES[name])
    order = [d[0] for d in want.description]
    assert sorted(order) == columns
    rows = sorted(tuple(map(shown, r)) for r in got.select(*columns).collect())
    assert rows == sorted(tuple(shown(r[order.index(c)]) for c in columns) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(everything.QUERIES) - set(everything.ORACLES)))
def test_query_without_sql_gives_rows(spark, name):
    assert everything.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry_registers_everything(spark):
    import __spark_entry__ as e

    assert set(everything.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["family", "motif", "hits", "sequences"]
