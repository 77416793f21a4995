import pytest

from tapisan.plans import acquisition, catalogue, problems  # noqa: F401
from tests.compare import rows, sql


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_agrees_with_sql(spark, data, name):
    got, want = catalogue.QUERIES[name](spark, data).toPandas(), sql(catalogue.SQL[name], data)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES | problems.QUERIES) - set(catalogue.SQL)))
def test_queries_without_sql_give_rows(spark, data, name):
    got = (catalogue.QUERIES | problems.QUERIES)[name](spark, data)
    assert got.count() > 0 and len(set(got.columns)) == len(got.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
