"""Every named query against its SQL on the smallest tables."""

import pytest
from compare import compare, duck
from conftest import SF_DIR

import __spark_entry__ as entry_points
from reviewlake.catalog import ORACLE, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, name) == ""


@pytest.mark.parametrize(
    "name", sorted(set(QUERIES) - set(ORACLE))
)
def test_query_without_sql_has_rows(spark, name):
    assert entry_points.queries()[name](spark, SF_DIR).count() > 0


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
