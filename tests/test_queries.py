"""Every query on the reference's operators against its SQL."""

import pytest

import __spark_entry__ as entry
from labelloom.plans import catalogue
from tests.oracle import connection, spark_rows, sql_rows


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    assert spark_rows(catalogue.QUERIES[name](spark, sf_dir)) == sql_rows(duck, catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs_without_sql(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
