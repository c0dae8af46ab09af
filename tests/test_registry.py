"""Queries that SQL cannot express run over the given tables and keep their bounds."""

import pytest

import __spark_entry__ as entry
from compare import duck

FOLDER = "/root/testdata/sf0.01"
QUERIES = entry.queries()
MODEL_QUERIES = sorted(set(QUERIES) - set(entry.oracle_sql()))


def _everyone():
    """Ids of the matrix with labels that follow the order lines."""
    everyone = entry.oracle_sql()["submission_check"].replace("select id, true as inside", "select count(*)")
    return duck(FOLDER).sql(everyone).fetchone()[0]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "id" and df.count() > 0


@pytest.mark.parametrize("name", MODEL_QUERIES)
def test_model_query(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert rows
    if "probabilidad" in df.columns:
        assert len(rows) == len({r.id for r in rows}) == _everyone()
        assert all(0 <= r.probabilidad <= 1 for r in rows)
    if name.endswith("_importance") and name != "permutation_importance":
        assert sum(r.importance for r in rows) <= 1 + 1e-9
    if "auc" in df.columns:
        assert 0 <= rows[0].auc <= 1
    if "error" in df.columns:
        assert all(r.error == r.wrong / r.n for r in rows)
