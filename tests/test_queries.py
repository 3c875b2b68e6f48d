"""Every registered query against its check SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry_point
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry_point.queries()))
def test_matches_sql(spark, db, name):
    problem = compare(spark, FOLDER, name, db)
    assert problem is None, problem


def test_entry_gives_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
