import pytest
from oracle import compare, connect

from sedimenta.plans import engine, engine_sql, problems, problems_sql

QUERIES = problems.QUERIES | engine.QUERIES
SQL = problems_sql.SQL | engine_sql.SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    compare(QUERIES[name](spark, sf_dir), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_finds_rows(spark, sf_dir, name):
    larger = sf_dir.replace("sf0.001", "sf0.01")  # the smallest tables hold no match for every written query
    assert QUERIES[name](spark, larger).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
