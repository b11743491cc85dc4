"""Every named query against its SQL statement, on the smallest tables."""

import pytest

from conftest import SMALL
from lectern.plans.catalog import QUERIES
from oracle.statements import ORACLES
from tools.compare import compare, connect


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


def test_every_query_is_compared():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, connection, name):
    good, note = compare(spark, connection, SMALL, name, ORACLES[name])
    assert good, note
