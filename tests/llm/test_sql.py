"""The operators that SQL can express, against it on the smallest tables."""

import glob
import os

import pytest

from tests.test_catalogue import norm
from weftline.llm import queries

SF = os.environ.get("WEFTLINE_TEST_SF", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cur = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    df = queries.queries()[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(repr([norm(r[columns.index(c)]) for c in sorted(columns)]) for r in cur.fetchall())
    assert sorted(repr([norm(r[c]) for c in sorted(columns)]) for r in df.collect()) == expected


@pytest.mark.parametrize("name", ["op4_source_mix", "op5_license_scan", "op7_paragraph_sketch", "op8_quality_rules"])
def test_native_operators_have_no_python(spark, name):
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
