"""All registered queries against their SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from wickwork.queries import ORACLES, QUERIES
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    with connect(SF) as connection:
        yield connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_sql(spark, con, key):
    assert differences(spark, con, QUERIES[key], ORACLES[key], SF) is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["symbol", "ts", "volume", "close"]
