"""Every registered query against its SQL, and the driver contract."""

import pytest

import __spark_entry__ as contract
from tests.compare import difference, oracle_connection
from tests.conftest import SMALL

ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert difference(contract.queries()[name](spark, SMALL), con, ORACLES[name]) is None


def test_entry_is_the_ranked_queue(spark):
    df = contract.entry(spark)
    ranks = sorted(r.priority_rank for r in df.select("priority_rank").collect())
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(contract.queries())
