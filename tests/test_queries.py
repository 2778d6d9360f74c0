"""Every registered query against its SQL on DuckDB, on the smallest given tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from compare import connect, differences
from featureops.plans.oracle import ORACLE
from featureops.plans.registry import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    assert differences(queries()[name](spark, SF_DIR), duck, oracle_sql()[name]) == []


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0
