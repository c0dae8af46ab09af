"""Every query with a SQL counterpart gives the same rows on the given tables."""

import pytest

import __spark_entry__ as entry
from compare import duck, rows_of

FOLDER = "/root/testdata/sf0.01"
SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    want = con.sql(SQL[name]).to_arrow_table()
    got = QUERIES[name](spark, FOLDER).toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    for column in got.column_names:
        assert got.schema.field(column).type == want.schema.field(column).type, column
    assert got.num_rows == want.num_rows > 0
    assert rows_of(got.to_pandas()) == rows_of(want.to_pandas())
