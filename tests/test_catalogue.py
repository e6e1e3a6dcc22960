"""Every query against its SQL on the smallest tables, and the contract of the entry module."""

import glob
import os

import pytest

from weftline.plans import catalogue

SF = os.environ.get("WEFTLINE_TEST_SF", "/root/testdata/sf0.001")


def norm(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cur = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(repr([norm(r[columns.index(c)]) for c in sorted(columns)]) for r in cur.fetchall())
    assert sorted(repr([norm(r[c]) for c in sorted(columns)]) for r in df.collect()) == expected


def test_entry_contract():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q)
    assert set(catalogue.queries()) <= set(q)
