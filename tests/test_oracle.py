"""Every registered query against its SQL, over whole tables."""

import pytest

import __spark_entry__ as entry
from verify import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name).startswith("ok")


def test_entry(spark):
    assert entry.entry(spark).count() == 335
