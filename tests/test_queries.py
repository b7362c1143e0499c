import pytest

import __spark_entry__ as contract
from verification.compare import connect, difference
from verification.oracle import ORACLES
from verification.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    assert difference(spark, duck, name, SF_DIR) is None


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())
    assert contract.entry(spark).count() == 6
