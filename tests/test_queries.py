"""Every query of the engine against its SQL over the smallest tables."""

import os

import pytest

from tests.compare import assert_same, connect
from tidelake.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, SF), con, catalog.ORACLES[name])
