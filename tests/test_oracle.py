"""Every catalogue query against its SQL oracle."""
import pytest
from helpers import SF
from oracle_check import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from stockhealth.plans.catalog import CATALOG


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle():
    assert set(CATALOG) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() == 60


@pytest.mark.parametrize("name", list(CATALOG))
def test_query(spark, con, name):
    assert differences(queries()[name](spark, SF), con, oracle_sql()[name]) == []
