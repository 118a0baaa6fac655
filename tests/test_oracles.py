"""Every query of the engine against its SQL on the smallest tables, order aside."""

import os

import duckdb
import pytest

from framelake import plans

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(t):
    t = t.select(sorted(t.column_names))
    one = lambda v: "NULL" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(one, r.values())) for r in t.to_pylist())


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got = plans.queries()[name](spark, DIR)
    want = duck.sql(plans.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toArrow()) == rows(want.to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert plans.queries()[name](spark, DIR).toArrow().num_rows > 0
