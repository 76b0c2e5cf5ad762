"""Every registered query against its SQL on the smallest given tables."""

import pytest

from checks.compare import compare, duck
from checks.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert ok, note
