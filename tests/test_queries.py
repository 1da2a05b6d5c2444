import glob
import os

import duckdb
import pytest

from tagloom.plans import queries as plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not there")
@pytest.mark.parametrize("name", plans.QUERIES)
def test_query_equals_sql(spark, sql, name):
    got = plans.QUERIES[name](spark, DATA).toArrow()
    wanted = sql.execute(plans.SQL[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(wanted.column_names)
    rows = lambda t: sorted(map(repr, zip(*(t[c].to_pylist() for c in columns), strict=True)))
    assert rows(got) == rows(wanted)


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.SQL)
