"""Every query against its SQL in another engine."""

import pytest

from tests.oracle import compare, duck
from turnloom.plans.mechanisms import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_all_have_sql():
    assert set(QUERIES) == set(SQL) and len(QUERIES) == 77


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    compare(spark, SF, QUERIES[name], SQL[name], con)
